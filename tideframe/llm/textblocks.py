"""Bytes of many texts as one numpy array: words, lines, and hashes of spans."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The C library's call that gives its free pages back; None where it has none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LENGTH = 0xD6E8FEB86659FD93
#: Values that are hashed at a time, few enough to stay in a core's cache.
_STEP = 1 << 15


def give_back() -> None:
    """Return memory that is free to the system, before a Python worker starts on its next group or batch.

    Workers outlive tasks and stages, and their allocators would keep the most that any group took.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blend(a: np.ndarray, b: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """One 64-bit number from two, in order; no linear relation between inputs carries over to the outcome."""
    out, seeds = np.empty(len(a), np.uint64), np.asarray(seed, np.uint64)
    spare = np.empty(min(_STEP, len(a)), np.uint64)
    for k in range(0, len(a), _STEP):
        x = out[k : k + _STEP]
        high = spare[: len(x)]
        np.bitwise_xor(a[k : k + _STEP], seeds[k : k + _STEP] if seeds.ndim else seeds, out=x)
        x *= _A
        x ^= np.right_shift(x, np.uint64(32), out=high)
        x += b[k : k + _STEP]
        x *= _B
        x ^= np.right_shift(x, np.uint64(29), out=high)
        x *= _C
        x ^= np.right_shift(x, np.uint64(32), out=high)
    return out


def eights(values: np.ndarray) -> np.ndarray:
    """A view of bytes in which each place holds the eight from there on as one number."""
    return np.ndarray((max(len(values) - 7, 0),), "<u8", values.tobytes(), 0, (1,))


class Spans:
    """Hashes of spans of a sequence, by doubling.

    A span whose length is a power of two has a number made of those of its halves; any other span is told by its length
    and the two spans of the largest power of two that begin and end it. While ``bits`` of a value leave room, a number
    holds the values themselves. Spans of one length that differ hash equal once in about 2**64; with another ``seed``
    the numbers are independent ones.
    """

    def __init__(self, values: np.ndarray, bits: int = 64, seed: int = 0):
        self._bits, self._seed, self._n = bits, seed, len(values)
        self._levels = {3: eights(values).copy()} if bits == 8 else {}
        self._levels[0] = values if bits == 8 else values.astype(np.uint64)

    def _itself(self, width: int) -> bool:
        """Whether spans of this length are hashed by their number alone: a power of two that doubling has mixed."""
        return width & (width - 1) == 0 and width * self._bits > 64

    def _salt(self, n: int) -> int:
        return (self._seed + n * _LENGTH) % (1 << 64)

    def level(self, k: int) -> np.ndarray:
        """Numbers of all spans of 2**k values; empty where there is none. The last ones asked for are kept."""
        at = max(x for x in self._levels if x <= k)
        now = self._levels[at].astype(np.uint64, copy=False)
        while at < k:
            half = 1 << at
            a, b = now[: max(len(now) - half, 0)], now[half:]
            now = a | (b << np.uint64(self._bits * half)) if 2 * half * self._bits <= 64 else blend(a, b, self._salt(at))
            at += 1
        if k not in self._levels:
            self._levels = {x: v for x, v in self._levels.items() if x in (0, 3) or x == max(self._levels)} | {k: now}
        return now

    def fixed(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` values."""
        k = width.bit_length() - 1
        now = self.level(k)
        if self._itself(width):
            return now
        n = max(self._n - width + 1, 0)
        return blend(now[:n], now[width - (1 << k) :][:n], self._salt(width))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans from ``start`` to before ``end``; an empty span has 0."""
        n = end - start
        out = np.zeros(len(start), np.uint64)
        deep = np.frexp(n.astype(np.float64))[1] - 1
        for k in np.unique(deep[n > 0]):
            rows = np.flatnonzero((deep == k) & (n > 0))
            now = self.level(int(k))
            if self._itself(1 << int(k)):
                own = n[rows] == 1 << int(k)
                out[rows[own]] = now[start[rows[own]]]
                rows = rows[~own]
            out[rows] = blend(now[start[rows]], now[end[rows] - (1 << int(k))], np.uint64(self._seed) + n[rows].astype(np.uint64) * np.uint64(_LENGTH))
        return out


class Block:
    """Texts joined in one buffer with a space after each; ``first[d]`` is where text d starts, ``last[d]`` where it ends."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.last = self.first + sizes

    def words(self) -> None:
        """Sets ``start`` and ``end`` of each word, ``word_doc`` and ``word_first`` (of each text, one more at the end)."""
        inside = ~SPACE[self.buffer]
        step = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.word_first = np.searchsorted(self.start, np.append(self.first, len(self.buffer)))
        self.n_words = np.diff(self.word_first)
        self.word_doc = np.repeat(np.arange(len(self.texts)), self.n_words)

    def word_values(self, seed: int = 0) -> np.ndarray:
        """A 64-bit number of each word, by its bytes: of up to 16 by its first and last eight, of longer ones by doubling."""
        n = self.end - self.start
        eight = eights(np.concatenate([self.buffer, np.zeros(8, np.uint8)]))
        size = np.minimum(n, 8).astype(np.uint64)
        mask = np.uint64(2**64 - 1) >> (np.uint64(64) - size * np.uint64(8)) if len(n) else size
        head = eight[self.start] & mask
        out = blend(head, np.where(n > 8, eight[np.maximum(self.end - 8, 0)], np.uint64(0)), np.uint64(seed) + n.astype(np.uint64) * np.uint64(_LENGTH))
        long = np.flatnonzero(n > 16)
        if len(long):
            stop = np.cumsum(n[long])
            own = self.buffer[np.arange(stop[-1]) + np.repeat(self.start[long] - (stop - n[long]), n[long])]
            out[long] = Spans(own, 8, seed).hash(stop - n[long], stop)
        return out


def cuts(column: pa.Array, most: int, overlap: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Row, place in its text and bytes of pieces, in lists of about ``most`` bytes, null as empty.

    A longer text comes in several pieces that overlap by ``overlap`` bytes, so that each string of one byte more lies whole
    in just one of them.
    """
    out, size = [], 0
    for k, x in enumerate(column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column):
        t = x.as_py() or b""
        for at in range(0, max(len(t) - overlap, 1), most):
            piece = t[at : at + most + overlap]
            if out and size + len(piece) > most:
                yield out
                out, size = [], 0
            out.append((k, at, piece))
            size += len(piece)
    if out:
        yield out


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts, null as empty, of pieces of about ``most`` bytes: bounded memory whatever a batch holds."""
    at, out, size = 0, [], 0
    for k, x in enumerate(column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column):
        t = x.as_py() or b""
        if out and size + len(t) > most:
            yield at, out
            at, out, size = k, [], 0
        out.append(t)
        size += len(t)
    if out:
        yield at, out
