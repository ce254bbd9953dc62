"""Which keys occur twice or more in a corpus, found with few and compact rows.

Texts belong to blocks by a hash of doc_id. A task packs the distinct 64-bit keys of the texts at hand into one binary row
for each range of keys; whoever holds a range sorts what came and answers each block with those of its keys that repeat.
A key that a task has often goes out once, with a mark, and is answered there and then, so a key that a third of all
documents share costs one entry a task and not one a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import give_back, mix64

BLOCK_BYTES, RANGE_BYTES = 4_000_000, 8_000_000
#: A key is hot if a task has it more than this often, or if more than this many entries for it arrive.
HOT_IN_TASK, HOT_ENTRIES = 4, 512

SENT = "range long, packed binary"
ANSWER = "block long, packed binary"
_SENT = pa.schema([("range", pa.int64()), ("packed", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("packed", pa.binary())])
_ENTRY = np.dtype([("key", "<u8"), ("block", "<i8"), ("mark", "u1")])
_REPLY = np.dtype([("key", "<u8"), ("hot", "?")])
#: With a second hash, where equal keys have to mean equal strings.
_SURE_ENTRY, _SURE_REPLY = np.dtype([*_ENTRY.descr, ("check", "<u8")]), np.dtype([*_REPLY.descr, ("check", "<u8")])


class Layout:
    """Numbers of blocks and key ranges for a corpus, both in proportion to its bytes."""

    def __init__(self, docs: DataFrame):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks, self.ranges = max(24, math.ceil(total / BLOCK_BYTES)), max(24, math.ceil(total / RANGE_BYTES))

    def block(self) -> Column:
        """By a hash of id and text, so that rows without an id, or of one id, are spread like any."""
        return F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.blocks)).alias("block")

    def range_of(self, key: np.ndarray) -> np.ndarray:
        # chosen keys are minima and so small; mixed again they lie evenly
        return ((mix64(key ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)


def by_range(layout: Layout, key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``rows``, one for each key, by range."""
    of = layout.range_of(key)
    order = np.argsort(of, kind="stable")
    of, rows = of[order], rows[order]
    for part, r in zip(np.split(rows, np.flatnonzero(np.diff(of)) + 1), of[np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])] if len(of) else [], strict=False):
        yield int(r), part


def _heads(key: np.ndarray, check: np.ndarray | None) -> np.ndarray:
    """Where each run of equal keys, and equal checks, begins."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if check is not None:
        new[1:] |= check[1:] != check[:-1]
    return np.flatnonzero(new)


def send(layout: Layout, key: np.ndarray, block: np.ndarray, check: np.ndarray | None = None) -> tuple[pa.RecordBatch, list[tuple[int, bytes]]]:
    """Entries for the ranges, and what can be answered at once (block, packed). key, block, check: of every occurrence."""
    order = np.lexsort((block, key) if check is None else (block, check, key))
    key, block, check = key[order], block[order], None if check is None else check[order]
    entry, answer = (_ENTRY, _REPLY) if check is None else (_SURE_ENTRY, _SURE_REPLY)
    first = _heads(key, check)
    count = np.diff(np.append(first, len(key)))
    often = np.repeat(count > HOT_IN_TASK, count)
    pair = np.ones(len(key), bool)
    head = np.zeros(len(key), bool)
    head[first] = True
    pair[1:] = head[1:] | (block[1:] != block[:-1])
    use = np.where(often, head, pair)
    entries = np.zeros(int(use.sum()), entry)
    entries["key"], entries["block"] = key[use], np.where(often, -1, block)[use]
    entries["mark"] = np.repeat(np.where(count > HOT_IN_TASK, 2, np.where(count > 1, 1, 0)), count)[use]
    if check is not None:
        entries["check"] = check[use]
    sent = [(r, part.tobytes()) for r, part in by_range(layout, entries["key"], entries)]
    now = []
    if often.any():
        at_once = np.flatnonzero(often & pair)
        b = block[at_once]
        o = np.argsort(b, kind="stable")
        for at in np.split(o, np.flatnonzero(np.diff(b[o])) + 1):
            reply = np.zeros(len(at), answer)
            reply["key"], reply["hot"] = key[at_once[at]], True
            if check is not None:
                reply["check"] = check[at_once[at]]
            now.append((int(b[at[0]]), reply.tobytes()))
    return pa.record_batch([pa.array([r for r, _ in sent], pa.int64()), pa.array([p for _, p in sent], pa.binary())], schema=_SENT), now


def _answer(table: pa.Table, sure: bool = False) -> pa.Table:
    give_back()
    entries = np.frombuffer(b"".join(table["packed"].to_pylist()), _SURE_ENTRY if sure else _ENTRY)
    entries = entries[np.lexsort((entries["check"], entries["key"])) if sure else np.argsort(entries["key"], kind="stable")]
    first = _heads(entries["key"], entries["check"] if sure else None)
    count = np.diff(np.append(first, len(entries)))
    mark = np.maximum.reduceat(entries["mark"], first) if len(first) else np.zeros(0, np.uint8)
    repeats, hot = (count > 1) | (mark > 0), (count > HOT_ENTRIES) | (mark == 2)
    use = np.repeat(repeats, count) & (entries["block"] >= 0)
    block = entries["block"][use]
    reply = np.zeros(len(block), _SURE_REPLY if sure else _REPLY)
    reply["key"], reply["hot"] = entries["key"][use], np.repeat(hot, count)[use]
    if sure:
        reply["check"] = entries["check"][use]
    order = np.argsort(block, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(block) else []
    return pa.table([pa.array([int(block[p[0]]) for p in parts], pa.int64()), pa.array([reply[p].tobytes() for p in parts], pa.binary())], schema=_ANSWER)


def answers(sent: DataFrame, sure: bool = False) -> DataFrame:
    """From rows of :func:`send` with an extra column ``block``, null but for what was answered at once, rows of ANSWER."""
    open_ = sent.where(F.col("block").isNull()).select("range", "packed")
    return open_.groupBy("range").applyInArrow(lambda table: _answer(table, sure), ANSWER).unionByName(sent.where(F.col("block").isNotNull()).select("block", "packed"))


def both(sent: pa.RecordBatch, now: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Entries and immediate answers as one batch of (range, packed, block)."""
    n = sent.num_rows
    return pa.record_batch(
        [
            pa.concat_arrays([sent["range"], pa.nulls(len(now), pa.int64())]),
            pa.concat_arrays([sent["packed"], pa.array([p for _, p in now], pa.binary())]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([b for b, _ in now], pa.int64())]),
        ],
        names=["range", "packed", "block"],
    )


BOTH = "range long, packed binary, block long"


class Replies:
    """What a block has been told: which of its keys repeat, and which of them are hot."""

    def __init__(self, packed: pa.ChunkedArray, sure: bool = False):
        reply = np.frombuffer(b"".join(packed.to_pylist()), _SURE_REPLY if sure else _REPLY)
        reply = reply[np.lexsort((reply["check"], reply["key"])) if sure else np.argsort(reply["key"], kind="stable")]
        heads = _heads(reply["key"], reply["check"] if sure else None)
        self.keys, self.checks = reply["key"][heads], reply["check"][heads] if sure else None
        self.is_hot = np.logical_or.reduceat(reply["hot"], heads) if len(heads) else np.zeros(0, bool)

    def find(self, key: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, with its check, whether it repeats, and whether it is hot."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), bool)
        last = len(self.keys) - 1
        at = np.minimum(np.searchsorted(self.keys, key), last)
        has = self.keys[at] == key
        if self.checks is not None:
            while len(off := np.flatnonzero(has & (self.checks[at] != check))):  # keys that are equal by chance
                at[off] += 1
                has[off] = (at[off] <= last) & (self.keys[np.minimum(at[off], last)] == key[off])
                at = np.minimum(at, last)
        return has, has & self.is_hot[at]


def chosen(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` unsigned values, where its smallest is, the last one of equals.

    Window minima come from running minima of pieces of that width, forward and backward. A position changes only where
    a new smallest value enters or the old one leaves; just those windows are searched.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    at = np.full(n, -1, np.int64)
    enters = np.flatnonzero(values[width - 1 :] == least)
    at[enters] = enters + width - 1
    leaves = np.concatenate([[0], np.flatnonzero(least[1:] > least[:-1]) + 1])
    leaves = leaves[at[leaves] < 0]
    for k in range(0, len(leaves), 20_000):
        s = leaves[k : k + 20_000]
        seen = values[s[:, None] + np.arange(width)[None, ::-1]]
        at[s] = s + width - 1 - np.argmin(seen, axis=1)
    return np.maximum.accumulate(at)  # places never go back
