"""Fill-in-the-middle documents: units are counted from sparse class changes that one automaton finds.

A unit is a run of ASCII letters or any other single character. The automaton knows every pair of an ASCII letter next to
another ASCII character, in both orders, and the three sentinels; characters beyond ASCII stand as one that is no letter.
Between two class changes a run counts one unit if it is of letters and its length otherwise, so the changes alone tell
how many units lie before any place. A first scan keeps the sum at the start of every piece of a text; a cut is looked up
in those sums, and only the piece that it falls in is scanned again, if it isn't the one that was scanned last.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of a text that are scanned at a time.
PIECE = 1 << 18
_SENTINEL = 2


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Finds class changes (value 1 where letters begin, 0 where they end) and sentinels, by their last character."""
    found = ahocorasick.Automaton()
    others = [chr(c) for c in range(128) if chr(c) not in string.ascii_letters]
    for letter in string.ascii_letters:
        for other in others:
            found.add_word(other + letter, 1)
            found.add_word(letter + other, 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(mark, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """Units of a text, by the sums before each of its pieces; ``marked`` if a sentinel stands in it."""

    def __init__(self, text: str, piece: int = PIECE):
        self._text, self._piece = text, piece
        self._before, self.marked, self._last = [0], False, (-1, None)
        for at in range(0, len(text), piece):
            runs, marked = self._scan(at)
            self._before.append(self._before[-1] + self._count(runs))
            self.marked |= marked
            self._last = at, runs
        self.count = self._before[-1]

    def _scan(self, at: int) -> tuple[np.ndarray, bool]:
        """Runs of a piece as rows (first place, whether of letters), with a last row for the end; if a sentinel ends in it.

        A run that began in an earlier piece has no first unit here: its row's kind is 2.
        """
        back = min(at, 2)
        part = self._text[at - back : at + self._piece].encode("ascii", "replace").decode("ascii")
        hits = np.fromiter(itertools.chain.from_iterable(automaton().iter(part)), np.int64).reshape(-1, 2)
        hits[:, 0] -= back
        hits = hits[hits[:, 0] >= 0]
        marks = hits[:, 1] == _SENTINEL
        changes = hits[~marks]
        letter = part[back : back + 1] in string.ascii_letters
        if not len(changes) or changes[0, 0] > 0:
            goes_on = back and letter and part[back - 1] in string.ascii_letters
            changes = np.concatenate([[[0, 2 if goes_on else int(letter)]], changes])
        return np.concatenate([changes, [[len(part) - back, 0]]]), bool(marks.any())

    @staticmethod
    def _units(runs: np.ndarray) -> np.ndarray:
        return np.where(runs[:-1, 1] == 0, np.diff(runs[:, 0]), runs[:-1, 1] == 1)

    def _count(self, runs: np.ndarray) -> int:
        return int(self._units(runs).sum())

    def place(self, k: int) -> int:
        """Where the first ``k`` units end, as a place in the text."""
        if k <= 0:
            return 0
        if k >= self.count:
            return len(self._text)
        n = bisect.bisect_right(self._before, k) - 1  # the piece in which unit k, counted from 0, begins
        if self._last[0] != n * self._piece:
            self._last = n * self._piece, self._scan(n * self._piece)[0]
        runs = self._last[1]
        before = self._before[n] + np.concatenate([[0], np.cumsum(self._units(runs))])
        row = int(np.searchsorted(before, k, "right")) - 1
        return n * self._piece + int(runs[row, 0]) + (k - int(before[row]))


def transform(text: str, draws: tuple[int, int, int, int], plain: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and of middle (None if plain), and output of one text with its four draws."""
    units = Units(text)
    n = units.count
    if not text or units.marked or draws[2] % 100 >= plain:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = units.place(first), units.place(second)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of an id; without an id those of the seed alone."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1:", plain: int = 90, spm: int = 20, most: int = 4_000_000) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text; others ignored).

    Cuts and form follow from doc_id and ``seed`` alone, so reruns agree. A text that is null, empty or holds a sentinel, and
    of the others those whose third draw is ``plain`` or more of 100, stay as they are, a null text as the empty one; of the
    rest ``spm`` of 100 put the suffix first. Rows without an id all get the same draws; rows of one id, and repeated rows,
    each stand for themselves. Outputs leave in batches of about ``most`` characters. Empty table: no rows.
    """
    rows = docs.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(at: int, stop: int, made: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([batch["doc_id"][at:stop], *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True))], names)

        for batch in batches:
            give_back()
            at, size, made = 0, 0, []
            of = list(zip(*(batch[f"_h{k}"].to_pylist() for k in range(1, 5)), strict=True))
            for k, x in enumerate(batch["text"]):
                made.append(transform(x.as_py() or "", of[k], plain, spm))
                size += len(made[-1][-1])
                if size >= most:
                    yield told(at, k + 1, made)
                    at, size, made = k + 1, 0, []
            if made:
                yield told(at, batch.num_rows, made)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(form: Column, output: Column) -> Column:
    """The text that a row of :func:`fill_in_middle` was made of: outputs that aren't plain hold each sentinel once."""
    part = F.split(output, "<[PSM]>", -1)
    swapped = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(swapped)
