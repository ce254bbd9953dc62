"""BPE encoding and decoding by speculation: propose tokens greedily, verify neighbours, merge exactly what fails.

A word is split greedily into the longest vocabulary tokens. Such a split is the one that merging would reach exactly if
every token is its own encoding and no merge would ever cross the border between two neighbours. The borders of all new
words of a batch are tested together with numpy; words with a border that fails go through the merge list instead.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .textblocks import give_back

_NEVER = np.int32(2**31 - 1)
#: White space as the pattern below has it.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
#: Chunks, and words, that a worker keeps in mind; when as many are new, those not seen since the last time are forgotten.
_CACHE = 200_000
#: Symbols up to which words are merged in step; each merge there moves a whole row.
_LONG = 128


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def newer_characters() -> tuple[dict[int, str], dict[int, str]]:
    """Where Python's character tables and the tokenizers library's differ, among characters that Python doesn't have.

    Two maps: letters and numbers of the regex module that the library takes for symbols, each to a symbol; and capitals,
    to what the library makes of them in lower case.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    cut = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")
    lower = normalizers.Lowercase()
    return {ord(c): "\u2603" for c in new if cut.pre_tokenize_str(c)}, {ord(c): x for c in new if (x := lower.normalize_str(c)) != c}


class WordBPE:
    """Encoder and decoder for a tokenizer file with lower-cased, byte-level words and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._marks = sorted({s[:2] for s in self.special})
        self._word = regex.compile(split["pattern"]["Regex"])
        self._alphabet = byte_alphabet()
        self._reach: dict[str, int] = {}  # how long a token with given first two characters can be
        self._inner, self._final = {}, {}  # tokens that a word goes on after, and that end one, without the suffix
        for t, k in self.vocab.items():
            if self.suffix and t.endswith(self.suffix) and t != self.suffix:
                self._final[t.removesuffix(self.suffix)] = k
            else:
                self._inner[t] = k
                self._reach[t[:2]] = max(self._reach.get(t[:2], 0), len(t))
        if not self.suffix:
            self._final = self._inner
        self._longest = max(map(len, self._final), default=0)
        self._merges = {}
        size = max(self.pieces) + 1
        self._left, self._right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self._made = np.full(size, -1, np.int32)  # at which place of the merge list a token is made
        for place, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self._merges.setdefault((x, y), (place, z))
            if self._made[z] < 0:
                self._left[z], self._right[z], self._made[z] = x, y, place
        keys = np.fromiter((x * size + y for x, y in self._merges), np.int64, len(self._merges))
        order = np.argsort(keys)
        self._keys, self._places = keys[order], np.fromiter((p for p, _ in self._merges.values()), np.int32, len(keys))[order]
        self._result = np.fromiter((z for _, z in self._merges.values()), np.int32, len(keys))
        self._size = size
        self._inner_right, self._inner_left = self._edge(self._right), self._edge(self._left)
        self._whole = self._find_whole()
        self._chunks, self._old_chunks = {}, {}
        self._words_known, self._old_words = {}, {}

    def _edge(self, child: np.ndarray) -> np.ndarray:
        """Row t: the tokens that in turn end (or begin) t while it is being made, first its outermost symbol, last t."""
        chain = [np.arange(self._size, dtype=np.int32)]
        while (down := np.where(chain[-1] >= 0, child[chain[-1]], -1)).max() >= 0:
            chain.append(down.astype(np.int32))
        deep = np.stack(chain, axis=1)
        depth = (deep >= 0).sum(axis=1)
        at = depth[:, None] - 1 - np.arange(deep.shape[1])[None, :]
        return np.where(at >= 0, np.take_along_axis(deep, np.maximum(at, 0), axis=1), -1)

    def _place(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * self._size + y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._places[at], _NEVER)

    def borders_hold(self, a: np.ndarray, b: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours, whether no merge (``upto`` a place) joins what ends ``a`` and what begins ``b``.

        While both are being made, the last part of ``a`` and the first part of ``b`` are replaced by larger ones, the one
        that is merged earlier first. A merge of two parts that meet happens if it comes before either is replaced; of
        equal places the one further left goes first.
        """
        i, j = np.zeros(len(a), np.intp), np.zeros(len(b), np.intp)
        ends, starts = self._inner_right[a], self._inner_left[b]
        rows, holds = np.arange(len(a)), np.ones(len(a), bool)
        last = ends.shape[1] - 1, starts.shape[1] - 1

        def gone(chain: np.ndarray, r: np.ndarray, k: np.ndarray, most: int) -> np.ndarray:
            above = np.where(k < most, chain[r, np.minimum(k + 1, most)], -1)
            return np.where(above >= 0, self._made[above], _NEVER)

        while len(rows):
            x, y = ends[rows, i[rows]], starts[rows, j[rows]]
            place, gone_x, gone_y = self._place(x, y), gone(ends, rows, i[rows], last[0]), gone(starts, rows, j[rows], last[1])
            joined = (place != _NEVER) & (place < gone_x) & (place <= gone_y)
            if upto is not None:
                joined &= (place != upto[rows]) | (gone_x != _NEVER) | (gone_y != _NEVER)
            holds[rows[joined]] = False
            more = ~joined & ((gone_x != _NEVER) | (gone_y != _NEVER))
            step = gone_x <= gone_y
            i[rows[more & step]] += 1
            j[rows[more & ~step]] += 1
            rows = rows[more]
        return holds

    def merge(self, words: list[str]) -> list[list[int]]:
        """Exact merging: the first place of the merge list, leftmost first, until none applies.

        Short words go in step with those of like length; a long one has a heap of its own, so that time is n log n.
        """
        out: list[list[int]] = [[]] * len(words)
        by_length = sorted((k for k in range(len(words)) if len(words[k]) <= _LONG), key=lambda k: len(words[k]))
        for k in range(len(words)):
            if len(words[k]) > _LONG:
                out[k] = self._merge_long(self._symbols(words[k]))
        at = 0
        while at < len(by_length):
            stop, longest = at, len(words[by_length[at]]) + 4
            while stop < len(by_length) and stop - at < 20_000 and len(words[by_length[stop]]) <= longest:
                stop += 1
            rows = by_length[at:stop]
            for k, ids in zip(rows, self._merge_rows([self._symbols(words[k]) for k in rows]), strict=True):
                out[k] = ids
            at = stop
        return out

    def _merge_rows(self, symbols: list[list[int]]) -> list[list[int]]:
        width = max(map(len, symbols))
        ids = np.full((len(symbols), width + 1), -1, np.int32)
        for k, row in enumerate(symbols):
            ids[k, : len(row)] = row
        place = np.where((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0), self._place(ids[:, :-1], ids[:, 1:]), _NEVER)
        rows, columns = np.arange(len(symbols)), np.arange(width + 1)
        while len(rows):
            k = place[rows].argmin(axis=1)
            some = place[rows, k] != _NEVER
            rows, k = rows[some], k[some]
            if not len(rows):
                break
            ids[rows, k] = self._result[place[rows, k]]
            shift = np.minimum(columns + (columns > k[:, None]), width)
            ids[rows] = np.take_along_axis(ids[rows], shift, axis=1)
            place[rows] = np.take_along_axis(place[rows], shift[:, :-1].clip(max=width - 1), axis=1)
            for j in (k - 1, k):
                r, j = rows[j >= 0], j[j >= 0]
                x, y = ids[r, j], ids[r, j + 1]
                place[r, j] = np.where(y >= 0, self._place(x, y), _NEVER)
        return [row[row >= 0].tolist() for row in ids]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Merging with a heap of (place, symbol) and links between the symbols that are left."""
        n, merges, low = len(ids), self._merges, (1 << 32) - 1
        row = np.array(ids, np.int32)
        place = self._place(row[:-1], row[1:])
        at = np.flatnonzero(place != _NEVER)
        heap = np.sort((place[at].astype(np.int64) << 32) | at).tolist()  # a sorted list is a heap
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            entry = pop(heap)
            i = entry & low
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if found is None or found[0] != entry >> 32:
                continue
            made = ids[i] = found[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get((made, ids[k]))) is not None:
                    push(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], made))) is not None:
                push(heap, found[0] << 32 | h)
        return [t for t in ids if t >= 0]

    def _symbols(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def _find_whole(self) -> np.ndarray:
        """Of each token, whether its own text encodes to it alone: its halves do, and meet in no other merge before."""
        made = np.flatnonzero(self._made >= 0)
        whole = np.ones(self._size, bool)
        whole[made] = self.borders_hold(self._left[made], self._right[made], upto=self._made[made])
        for t in made[np.argsort(self._made[made])]:
            whole[t] &= whole[self._left[t]] and whole[self._right[t]]
        return whole

    def _propose(self, word: str) -> list[int]:
        n, at, out, inner, final, reach = len(word), 0, [], self._inner, self._final, self._reach
        while True:
            token = final.get(word[at:]) if n - at <= self._longest else None
            if token is not None:
                out.append(token)
                return out
            for end in range(min(n - 1, at + reach.get(word[at : at + 2], 1)), at, -1):
                token = inner.get(word[at:end])
                if token is not None:
                    break
            out.append(token)
            at = end

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, given in the byte alphabet without the suffix."""
        proposed = [self._propose(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.intp, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int32, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        fails = np.zeros(len(words), bool)
        fails[owner[~self._whole[flat]]] = True
        inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) else np.zeros(0, np.intp)
        if len(inside):
            pairs, back = np.unique(flat[inside].astype(np.int64) * self._size + flat[inside + 1], return_inverse=True)
            holds = self.borders_hold((pairs // self._size).astype(np.int32), (pairs % self._size).astype(np.int32))
            fails[owner[inside[~holds[back]]]] = True
        failing = np.flatnonzero(fails).tolist()
        for k, ids in zip(failing, self.merge([words[k] for k in failing]), strict=True):
            proposed[k] = ids
        return proposed

    def _split(self, chunk: str) -> list[str | int]:
        """Words, in lower case, of a chunk without white space; special tokens as ids."""
        if self._special and any(m in chunk for m in self._marks):
            return [w for k, part in enumerate(self._special.split(chunk)) for w in ([self.special[part]] if k % 2 else self._plain(part))]
        return self._plain(chunk)

    def _plain(self, part: str) -> list[str]:
        if part.isascii():
            low = part.lower()
            return [low] if low.isalpha() else self._word.findall(low)
        symbols, capitals = newer_characters()
        low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower().translate(capitals)
        if low.isalpha():
            return [low]
        masked = low.translate(symbols)
        return self._word.findall(low) if masked == low else [low[m.start() : m.end()] for m in self._word.finditer(masked)]

    def _in_bytes(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self._alphabet.__getitem__, word.encode()))

    def _learn(self, chunks: Iterable[str]) -> None:
        words, old = self._words_known, self._old_words
        split = {c: self._split(c) for c in chunks}
        new = set()
        for ws in split.values():
            for w in ws:
                if w not in words and not isinstance(w, int):
                    if (was := old.get(w)) is not None:
                        words[w] = was
                    else:
                        new.add(w)
        new = list(new)
        for w, ids in zip(new, self.encode_words([self._in_bytes(w) for w in new]), strict=True):
            words[w] = struct.pack(f"<{len(ids)}I", *ids)
        for c, ws in split.items():
            self._chunks[c] = words[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else b"".join([w.to_bytes(4, "little") if isinstance(w, int) else words[w] for w in ws])
        if len(words) > _CACHE:
            self._words_known, self._old_words = {}, words

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [list(filter(None, _SPACE.split(t))) if _SEPARATORS.search(t) else t.split() for t in texts]
        if len(self._chunks) > _CACHE:
            self._chunks, self._old_chunks = {}, self._chunks
        known, old = self._chunks, self._old_chunks
        unknown = []
        for c in {c for cs in chunks for c in cs} - known.keys():
            if (was := old.get(c)) is not None:
                known[c] = was
            else:
                unknown.append(c)
        self._learn(unknown)
        for cs in chunks:
            yield b"".join(map(known.__getitem__, cs))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: this vocabulary has no decoder, so tokens as they stand, with spaces between them."""
        return " ".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """The tokenizer of a file, once in each Python worker."""
    return WordBPE(path)


def _batches(texts: pa.ChunkedArray | pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    """Texts, null as empty, in lists of about ``most`` characters: bounded memory whatever a batch holds."""
    out, size = [], 0
    for x in texts:
        t = x.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``path``: a tokenizer file that every executor can open. Null and empty texts give an empty array; rows are encoded
    one by one, so null or repeated doc_id and repeated rows stay as they are. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            give_back()
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for texts in _batches(batch["text"]) for b in tokenizer.encode_batch(texts)]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of :func:`encode_documents`. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            give_back()
            texts = [None if not x.is_valid else tokenizer.decode(x.as_py()) for x in batch["ids"]]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; doc_id, n_tokens and the SHA-256 of the ids and of the decoded text.

    Cases as in :func:`encode_documents`; the ids never leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            give_back()
            counts, of_ids, of_text = [], [], []
            for texts in _batches(batch["text"]):
                for b in tokenizer.encode_batch(texts):
                    ids = np.frombuffer(b, "<u4")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(b).hexdigest())
                    of_text.append(hashlib.sha256(tokenizer.decode(ids.tolist()).encode()).hexdigest())
            yield pa.record_batch([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
