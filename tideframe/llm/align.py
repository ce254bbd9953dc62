"""Alignment of two tokenizers: bitsets of token ends, their common bits, and links counted over the corpus.

Both tokenizations of a text cover the same bytes. Each marks its token ends in a packed bitset over those bytes. The bits
that both have are the cuts between groups; ranks (set bits before a byte, from a directory of word counts) map a cut to
token ranges. The bits that either has end the segments in which one token of each side meets, so they are the links.

Neither tokenizer joins anything across a space that follows a character which isn't white space. Texts are taken apart
there, equal parts of a block of texts are tokenized and aligned once, and what is known of a text follows from its
parts. A block's distinct pairs are counted by its texts, totalled over the corpus by key, and sent back to the block.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .store import discard, durable, one_row_a_batch
from .textblocks import give_back

#: Bytes of text after which a block ends, and characters of a long text that are taken apart at a time.
BLOCK_BYTES, PIECE = 16_000_000, 1_000_000
_GAP = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")
_PAIR = 16
#: Words of letters and signs that every version of Unicode's tables knows alike, and how a byte-level tokenizer splits them.
_PLAIN = re.compile("[!-~\u00a1-\u024f]{1,200}")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 2) // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self._before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """Places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _counts(rows: list) -> np.ndarray:
    return np.fromiter(map(len, rows), np.int64, len(rows))


class Table:
    """Bytes of a vocabulary's tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = _counts(tokens)
        self._first, self._all = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self._all[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._first[ids] - (ends - size), size)]


class Tokens:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        spec = json.loads(self.a.to_str())
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        # where tokens are numbered as they are merged, plain words go the faster way of merging by number
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        byte_level = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        ranked = byte_level and all(vocab[x + y] == 256 + k for k, (x, y) in enumerate(merges))
        ranks = {self.a_bytes[k]: k for k in vocab.values() if k < 256 + len(merges)}
        self._plain = tiktoken.Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranked and len(ranks) == 256 + len(merges) else None
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on after a space
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _PAIR:
            raise ValueError("vocabularies of up to 65,536 tokens are expected")
        self.a_table, self.b_table = Table(self.a_bytes), Table(self.b_bytes)
        # a token's number as it stands in a group: followed by another of its side, or by the other side or group
        self.shown = [f"{k}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for k in range(n)]

    def _encode_a(self, parts: list[str]) -> list[list[int]]:
        out = [[]] * len(parts)
        rest = [k for k, p in enumerate(parts) if self._plain is None or not _PLAIN.fullmatch(p)]
        if self._plain is not None:
            out = [self._plain.encode_ordinary(" " + p) if _PLAIN.fullmatch(p) else [] for p in parts]
        for k, e in zip(rest, self.a.encode_batch_fast([" " + parts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def encode(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Both encodings of a space and each part, as ids and counts, none where the bytes of either aren't those of the part."""
        a = self._encode_a(parts)
        b = self.b.encode(parts, num_threads=1)
        for k in [k for k, p in enumerate(parts) if not p]:
            b[k] = [self.b.piece_to_id("▁")]  # a space at a text's end
        texts = [b" " + p.encode() for p in parts]
        whole, out = np.ones(len(parts), bool), []
        while not out:
            size, now = _counts(texts), np.frombuffer(b"".join(texts), np.uint8)
            of = np.repeat(np.arange(len(parts)), size)
            for rows, table in ((a, self.a_table), (b, self.b_table)):
                ids, n = np.fromiter(itertools.chain.from_iterable(rows), np.int64), _counts(rows)
                same = np.add.reduceat(np.append(table.size[ids], 0), np.cumsum(n) - n) * (n > 0) == size
                if same.all() and len(now):
                    same &= np.bincount(of[table.joined(ids) != now], minlength=len(parts)) == 0
                whole &= same
                out += [ids, n]
            for k in np.flatnonzero(~whole):
                if texts[k]:
                    a[k], b[k], texts[k], out = [], [], b"", []
        return *out, whole


@functools.lru_cache(maxsize=1)
def load(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


class Aligned:
    """Alignment of many parts at once: counts and links of each, and how its groups read."""

    def __init__(self, tokens: Tokens, parts: list[str]):
        ids_a, self.n_a, ids_b, self.n_b, self.whole = tokens.encode(parts)
        ends_a, ends_b = np.cumsum(tokens.a_table.size[ids_a]), np.cumsum(tokens.b_table.size[ids_b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        in_a, in_b = Bits.of(ends_a, size), Bits.of(ends_b, size)
        cuts, segments = (in_a & in_b).select(), (in_a | in_b).select()
        part_end = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]
        of = lambda places: np.diff(np.searchsorted(places, part_end, "right"), prepend=0)
        self.n_groups, self.n_links = of(cuts), of(segments)
        # a segment lies in the tokens whose ends are the first at or after its own
        pair = ids_a[in_a.rank(segments)] << _PAIR | ids_b[in_b.rank(segments)]
        self.pairs, self.first = pair, np.concatenate([[0], np.cumsum(self.n_links)])
        # the order of writing: of a group first the tokens of one side, then those of the other
        own_a, own_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        start, end = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts, cuts
        before_b = in_b.rank(start + 1) if len(cuts) else cuts  # tokens that end at or before the group's start
        upto_a = in_a.rank(end + 1)
        at_a = np.arange(len(ids_a)) + before_b[own_a]
        at_b = np.arange(len(ids_b)) + upto_a[own_b]
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        va, vb = len(tokens.a_bytes), len(tokens.b_bytes)
        shown[at_a] = ids_a + va * (ends_a == end[own_a])
        shown[at_b] = 2 * va + ids_b + vb * (ends_b == end[own_b])
        words, stop = list(map(tokens.shown.__getitem__, shown.tolist())), np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = [b"".join(words[s:e]) for s, e in zip([0, *stop], stop, strict=False)]


def parts_of(text: str, parts: bool = True, piece: int = PIECE) -> Iterator[list[str]]:
    """The text's parts in order, without the space before each, in lists of about ``piece`` characters."""
    at = stop = 0
    while text and stop < len(text):
        at, stop = stop + (stop > 0), len(text)
        if parts and stop - at > piece:
            found = _GAP.search(text, at + piece)
            stop = found.start() if found else stop
        now = text[at:stop]
        if not parts:
            yield [now]
        elif _WIDE.search(now) or now[:1] == " ":
            yield [p if k == 0 else p[1:] for k, p in enumerate(_GAP.split(now))]
        else:
            yield now.split(" ")


class _Text:
    """What is known of a row's text so far: its parts' numbers, and its groups or their hash."""

    def __init__(self, doc_id, digest: bool):
        self.doc_id, self.parts, self.whole = doc_id, [], True
        self._hash, self._shown, self._last = hashlib.sha256() if digest else None, [], b""

    def add(self, parts: np.ndarray, groups: list[bytes], whole: np.ndarray) -> None:
        self.parts.append(parts.astype(np.int32))
        self.whole &= bool(whole[parts].all())
        self._write(self._last)
        self._last = b"".join(map(groups.__getitem__, parts.tolist())) if self.whole else b""

    def _write(self, now: bytes) -> None:
        if self._hash is None:
            self._shown.append(now)
        else:
            self._hash.update(now)

    def close(self) -> tuple[np.ndarray, np.ndarray, str]:
        """Distinct parts, how often each stands here, and the groups or their digest; nothing without tokens."""
        if not self.parts or not self.whole:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        self._write(self._last[:-1])
        return *np.unique(np.concatenate(self.parts), return_counts=True), b"".join(self._shown).decode() if self._hash is None else self._hash.hexdigest()


def _pack(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<i4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i4")


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


class _Block:
    """Rows of a task up to some bytes of text; equal parts are tokenized once."""

    def __init__(self, tokens: Tokens, digest: bool):
        self._tokens, self._digest = tokens, digest
        self._known: dict[str, int] = {}
        self._held: list[Aligned] = []
        self._groups, self._whole = [], np.zeros(0, bool)
        self._texts, self._open, self._waits = [], [], 0
        self.size = 0

    def add(self, doc_id, text: str) -> None:
        row = _Text(doc_id, self._digest)
        self._texts.append(row)
        self.size += len(text) + 100
        for parts in parts_of(text, self._tokens.parts):
            self._open.append((row, parts))
            self._waits += sum(map(len, parts)) + 100
            if self._waits >= PIECE:
                self._learn()

    def _learn(self) -> None:
        known = self._known
        new = list({p: None for _, parts in self._open for p in parts if p not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._held.append(Aligned(self._tokens, new))
            self._groups += self._held[-1].groups
            self._whole = np.concatenate([self._whole, self._held[-1].whole])
        for row, parts in self._open:
            row.add(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)), self._groups, self._whole)
        self._open, self._waits = [], 0

    def close(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        self._learn()
        whole = lambda what: np.concatenate([np.zeros(0, np.int64), *(getattr(h, what) for h in self._held)])
        closed = [row.close() for row in self._texts]
        pairs, place = np.unique(whole("pairs"), return_inverse=True)
        sums = {k: whole(k) for k in _SUMS}
        uses, total = np.zeros(len(self._known), np.int64), np.zeros(len(pairs), np.int64)
        for used, times, _ in closed:
            uses[used] += times
        np.add.at(total, place, np.repeat(uses, sums["n_links"]))
        docs = {"doc_id": pa.array([row.doc_id for row in self._texts], id_type)}
        docs |= {k: pa.array([int((v[used] * times).sum()) for used, times, _ in closed], pa.int64()) for k, v in sums.items()}
        docs["groups"] = pa.array([shown for *_, shown in closed], pa.string())
        docs["used"] = pa.array([_pack(np.diff(used, prepend=0)) for used, _, _ in closed], pa.binary())
        docs["times"] = pa.array([_pack(times) for _, times, _ in closed], pa.binary())
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [pa.array([name]), one(pa.StructArray.from_arrays(list(docs.values()), list(docs))), pa.array([_pack(sums["n_links"])]), pa.array([_pack(place)]), one(pa.array(pairs)), one(pa.array(total))]
        return pa.record_batch(columns, ["block", "docs", "links", "place", "pairs", "counts"])


def _blocks(docs: DataFrame, a_path: str, b_path: str, digest: bool, most: int) -> DataFrame:
    """A row for each block: its texts' sums, digest or groups, and parts; its parts' links; its distinct pairs with counts."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seq, block = load(a_path, b_path), 0, None
        for batch in batches:
            give_back()
            for k, x in enumerate(batch["text"]):
                block = block or _Block(tokens, digest)
                block.add(batch["doc_id"][k].as_py(), x.as_py() or "")
                if block.size >= most:
                    yield block.close(f"{TaskContext.get().partitionId()}-{seq}", batch["doc_id"].type)
                    seq, block = seq + 1, None
        if block:
            yield block.close(f"{TaskContext.get().partitionId()}-{seq}", batch["doc_id"].type)

    schema = f"block string, docs array<struct<doc_id: {id_type}, {', '.join(f'{k}: bigint' for k in _SUMS)}, groups: string, used: binary, times: binary>>"
    return rows.mapInArrow(run, f"{schema}, links binary, place binary, pairs array<bigint>, counts array<bigint>")


def link_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, count and best of every pair of token ids that is linked: its links in the corpus, and if none of ``b`` has more.

    A token has no more partners than the other vocabulary has tokens, so the window over the partners of ``b`` is bounded.
    """
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0")
    split = total.withColumns({"a": F.shiftright("pair", _PAIR), "b": F.col("pair").bitwiseAND(F.lit((1 << _PAIR) - 1))})
    return split.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align_documents(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``docs`` (doc_id, text; others ignored).

    ``a_path``: a byte-level tokenizers file, which gets a space and the text; ``b_path``: a sentencepiece model, which adds
    the space; every executor can open both. Special tokens' strings are plain text. groups: ``a1,a2|b1;a3|b2,b3``, the ids of
    each group between bytes where tokens of both end; with ``digest`` its SHA-256. Links are the pairs of tokens that share
    a byte; n_best counts those whose id pair is the most frequent of its B id in the corpus, ties included, and count_sum
    adds up the pairs' corpus counts. A text that is null, empty or isn't what the tokens' bytes join to (U+2581 is one
    reason) has no tokens: zeros and ''. Rows stand for themselves, also those without or with equal id, or equal throughout;
    each counts. Long texts are taken apart at single spaces; what has none is tokenized at once. Empty table: no rows.
    """
    spark = docs.sparkSession
    blocks = durable(_blocks(docs, a_path, b_path, digest, most), "align-blocks")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = durable(link_counts(blocks).select("pair", "count", "best"), "align-counts")
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    # pairs that only texts without tokens would have aren't counted
    answers = asked.join(counts, "pair", "left").groupBy("block").agg(F.collect_list(F.struct("pair", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(False)).alias("best"))).alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                rows, answer = batch["docs"][k].values, batch["answer"][k].values
                links, place = _unpack(batch["links"][k].as_py()), _unpack(batch["place"][k].as_py())
                if answer is None:
                    per_part = [np.zeros(len(links), np.int64)] * 2
                else:
                    order = np.argsort(answer.field("pair").to_numpy())
                    first = np.concatenate([[0], np.cumsum(links)])
                    sums = (np.concatenate([[0], np.cumsum(answer.field(f).to_numpy(zero_copy_only=False).astype(np.int64)[order][place])]) for f in ("best", "count"))
                    per_part = [s[first[1:]] - s[first[:-1]] for s in sums]
                n = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
                for r, (used, times) in enumerate(zip(rows.field("used"), rows.field("times"), strict=True)):
                    at, often = np.cumsum(_unpack(used.as_py())), _unpack(times.as_py()).astype(np.int64)
                    for out, per in zip(n, per_part, strict=True):
                        out[r] = (per[at] * often).sum()
                yield pa.record_batch([rows.field("doc_id"), *(rows.field(f) for f in _SUMS), *map(pa.array, n), rows.field("groups")], ["doc_id", *_SUMS, "n_best", "count_sum", "groups"])

    joined = blocks.select("block", "docs", "links", "place").join(answers, "block", "left").select("docs", "links", "place", "answer")
    with one_row_a_batch(spark):  # a block is MBs
        out = durable(joined.mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{k} long' for k in _SUMS)}, n_best long, count_sum long, groups string"), "align-documents")
    discard(blocks)
    discard(counts)
    return out
