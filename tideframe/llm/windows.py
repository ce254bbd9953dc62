"""Substring dedup: windows of words that occur twice, by level-wise doubling.

Level 1 looks at nine-word windows, of which each window of the full length has a chosen one, the same wherever the full
window stands. Those that repeat are extended to twice that length, to the right and to the left; where such a window
repeats, the full-length windows around it are candidates, two doubled windows with their overlap. Those that repeat are
removed. A window that is alone at one length takes no part in the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import ANSWER, BOTH, Layout, Replies, answers, both, chosen, send
from .store import discard, durable
from .textblocks import Block, Spans, give_back, mix64, slices

_OTHER = 0x2545F4914F6CDD1D
_SALT = np.array([0x51ED270B5C1D5A3F, 0xA24BAED4963EE407], np.uint64)


class WindowBlock(Block):
    """A block with its full-length windows and the chosen short window of each."""

    def __init__(self, texts: list[bytes], width: int):
        super().__init__(texts)
        self.words()
        self.width, self.short = width, max(1, (width + 3) // 4)
        self.spans, self.other = Spans(self.word_values()), Spans(self.word_values(_OTHER), seed=_OTHER)
        n = len(self.start)
        at = np.arange(max(n - width + 1, 0))
        self.at = at[self.word_doc[at] == self.word_doc[at + width - 1]] if len(at) else at
        self.value = self.spans.fixed(self.short)
        self.pick = chosen((self.value >> np.uint64(32)).astype(np.uint32), width - self.short + 1)[self.at] if len(self.at) else self.at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and place of each chosen short window."""
        place = np.unique(self.pick)
        return self.value[place], place

    def doubled(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows of twice the short length that begin and that end with the short one at each place; 0: none."""
        s, doc, n = self.short, self.word_doc, len(self.start)
        out = []
        for salt, begin in zip(_SALT, (place, place - s), strict=True):
            fits = (begin >= 0) & (begin + 2 * s <= n)
            b = np.where(fits, begin, 0)
            fits &= doc[np.minimum(b, n - 1)] == doc[np.minimum(b + 2 * s, n) - 1]
            out.append(np.where(fits, mix64(self.spans.hash(b, np.where(fits, b + 2 * s, b)) ^ salt), np.uint64(0)))
        return out[0], out[1]

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the full window at each of ``at``, by which windows are told to be equal."""
        return self.spans.hash(at, at + self.width), self.other.hash(at, at + self.width)

    def full(self, place: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """First word of the full windows whose short one is at ``place`` and that hold a repeating doubled one."""
        if not len(place) or not len(self.at):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(place, self.pick), len(place) - 1)
        into = self.pick - self.at
        use = (place[k] == self.pick) & ((right[k] & (into + 2 * self.short <= self.width)) | (left[k] & (into >= self.short)))
        return self.at[use]


def _level(docs: DataFrame, layout: Layout, told: DataFrame | None, keys: Callable, name: str, sure: bool = False) -> DataFrame:
    """One level: keys of every text (with what its block was told before), and the answers to them.

    ``sure``: keys come with a second hash, as the answers decide.
    """
    rows = docs.select("doc_id", "text", layout.block())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            blocks = batch["block"].to_numpy()
            for at, texts in slices(batch["text"]):
                key, doc = keys(texts, None)
                yield both(*send(layout, key, blocks[at + doc]))

    def group(block: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        known, out = Replies(replies["packed"]), []
        for _, part in slices(texts["text"].combine_chunks()):
            key, check = keys(part, known)
            if len(key):
                out.append(both(*send(layout, key, np.full(len(key), block[0].as_py()), check)))
        return pa.Table.from_batches(out) if out else pa.table({"range": pa.nulls(0, pa.int64()), "packed": pa.nulls(0, pa.binary()), "block": pa.nulls(0, pa.int64())})

    sent = rows.mapInArrow(scan, BOTH) if told is None else rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(group, BOTH)
    sent = durable(sent, f"windows-{name}-sent")
    out = durable(answers(sent, sure), f"windows-{name}")
    discard(sent)
    return out


def remove_repeats(docs: DataFrame, width: int = 35, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts anywhere else.

    One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_removed, kept_sha256 and,
    if asked for, kept, the kept words joined by one space. Words are runs of anything but space, tab and \\n \\v \\f \\r;
    windows lie in one row's text and are judged on the input; they are told to be equal by 128 bits of hashes. Null text: as
    empty, no words. Texts under ``width`` words lose nothing. Repeated rows are copies of each other and lose all they have
    in windows. Null doc_id: like any. Empty table: no rows.
    """
    layout = Layout(docs)

    def first(texts: list[bytes], _: None) -> tuple[np.ndarray, np.ndarray]:
        b = WindowBlock(texts, width)
        key, place = b.anchors()
        return key, b.word_doc[place]

    def second(texts: list[bytes], known: Replies) -> tuple[np.ndarray, None]:
        b = WindowBlock(texts, width)
        key, place = b.anchors()
        right, left = b.doubled(place[known.find(key)[0]])
        key = np.concatenate([right, left])
        return key[key != 0], None

    def third(texts: list[bytes], known: Replies) -> tuple[np.ndarray, np.ndarray]:
        b = WindowBlock(texts, width)
        _, place = b.anchors()
        right, left = (known.find(k)[0] for k in b.doubled(place))
        return b.names(b.full(place, right, left))

    level1 = _level(docs, layout, None, first, "1")
    level2 = _level(docs, layout, level1, second, "2")
    discard(level1)
    level3 = _level(docs, layout, level2, third, "3", sure=True)
    discard(level2)

    rows = docs.select("doc_id", "text", layout.block())
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def judge(texts: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        known, n, gone, digests, kept = Replies(replies["packed"], sure=True), [], [], [], []
        for _, part in slices(texts["text"].combine_chunks()):
            b = WindowBlock(part, width)
            at = b.at[known.find(*b.names(b.at))[0]] if len(b.at) else b.at
            marks = np.zeros(len(b.start) + 1, np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + width, -1)
            covered = np.cumsum(marks)[:-1] > 0
            removed = np.add.reduceat(np.append(covered, 0), b.word_first[:-1]) * (b.n_words > 0) if len(part) else []
            n += b.n_words.tolist()
            gone += [int(x) for x in removed]
            for d, text in enumerate(part):
                words = text.split()
                if removed[d]:
                    words = [words[k] for k in np.flatnonzero(~covered[b.word_first[d] : b.word_first[d + 1]])]
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode())
        columns = {"doc_id": texts["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return rows.groupBy("block").cogroup(level3.groupBy("block")).applyInArrow(judge, schema)
