"""Language identification by bitmasks: bit-sliced Bloom filters over n-grams.

One table of slots holds the Bloom filters of all languages, a bit for each: the languages that contain an n-gram are the
and of the slots its hashes name. A text's votes are per-language counts over its n-grams; the share of n-grams that a
filter of that fill takes by mistake is taken off again before the counts decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import mix64, slices

GRAM = 5
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))
_SEEDS = np.array([0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of five bytes, as numbers, and of which text each is: lower case, other than letters one space."""
    parts = [b" " + t.lower().encode().translate(_TO_SPACE) + b" " for t in texts]
    joined = np.frombuffer(b"".join(parts), np.uint8)
    doc = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
    space = joined == 32
    keep = np.ones(len(joined), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    joined, doc = joined[keep].astype(np.uint64), doc[keep]
    n = len(joined) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = joined[:n].copy()
    for k in range(1, GRAM):
        out |= joined[k : k + n] << np.uint64(8 * k)
    inside = doc[:n] == doc[GRAM - 1 :]
    return out[inside], doc[:n][inside]


@dataclass(frozen=True)
class LanguageFilters:
    """``slots`` (slots x 64-bit words of languages), how full each language's filter is, the languages' names, and the
    place of the one to fall back on."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray
    common: int = 0

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], bits: int | None = None, common: str | None = None) -> LanguageFilters:
        """Filters of 2**bits slots from each language's n-grams; by default 2**20, or eight a gram of the largest profile."""
        languages = sorted(profiles)
        bits = bits or max(20, (8 * max((len(p) for p in profiles.values()), default=0)).bit_length())
        slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        fill = np.zeros(len(languages))
        for k, name in enumerate(languages):
            at = cls._slots_of(profiles[name].astype(np.uint64), bits)
            np.bitwise_or.at(slots[:, k // 64], at.ravel(), np.uint64(1) << np.uint64(k % 64))
            fill[k] = len(np.unique(at)) / (1 << bits)
        return cls(languages, slots, fill, languages.index(common) if common in profiles else 0)

    @staticmethod
    def _slots_of(gram: np.ndarray, bits: int) -> np.ndarray:
        return (mix64(gram[None, :] ^ _SEEDS[:, None]) >> np.uint64(64 - bits)).astype(np.int64)

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages whose filter has it."""
        at = self._slots_of(gram, int(len(self.slots)).bit_length() - 1)
        return self.slots[at[0]] & self.slots[at[1]] & self.slots[at[2]]

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (its share of all languages' corrected votes) of each text.

        ``und`` with score 0 for a null text, one without a letter, or without any language to choose from. Where no filter
        has anything of a text, the language most common in training, with score 0; of equal votes the first by name.
        """
        known = [t if t is not None and _LETTER.search(t) else "" for t in texts]
        gram, doc = grams(known)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        mask = self.containing(gram)
        votes = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            has = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            votes[:, k] = np.bincount(doc, weights=has, minlength=len(texts))
        wrong = self.fill ** len(_SEEDS)
        votes = np.maximum((votes - n[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0)
        total = votes.sum(axis=1)
        best = np.where(total > 0, votes.argmax(axis=1), self.common) if len(self.languages) else np.zeros(len(texts), np.int64)
        names = [self.languages[b] if t and self.languages else UNDETERMINED for t, b in zip(known, best, strict=True)]
        top = votes.max(axis=1, initial=0)
        score = np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)
        return names, np.where([x != UNDETERMINED for x in names], score, 0.0)


def train_filters(docs: DataFrame, most_docs: int = 400, least_docs: int = 2, grain: int = 1 << 30) -> LanguageFilters:
    """Filters from the text and lang columns of ``docs``; rows where either is null teach nothing.

    At most about ``most_docs`` rows of a language are used, whole, drawn by a hash of their text, and of those all n-grams
    that ``least_docs`` or more of them have, or that a language with fewer rows has at all. Counting is distributed; the
    driver gets the n-grams, whose number the sample bounds.
    """
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return LanguageFilters.build({})
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(grain, grain * most_docs // n))])
    sample = told.where(F.pmod(F.xxhash64("text"), F.lit(grain)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for at, texts in slices(batch["text"]):
                names, of = np.unique(langs[at : at + len(texts)].astype(str), return_inverse=True)
                gram, doc = grams([t.decode() for t in texts])
                for k, name in enumerate(names):
                    mine = of[doc] == k
                    place = np.cumsum(np.bincount(np.flatnonzero(of == k), minlength=len(of))) - 1  # texts of the language, numbered
                    own, counts = gram[mine], place[doc[mine]].astype(np.uint64)
                    for low in range(0, int(place[-1]) + 1, 1 << 24):  # a gram has 40 bits, a text's number the other 24
                        use = (counts >= low) & (counts < low + (1 << 24))
                        both = np.unique(own[use] << np.uint64(24) | counts[use] - np.uint64(low)) >> np.uint64(24)
                        found, n = np.unique(both, return_counts=True)
                        yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    few = F.col("lang").isin([k for k, n in counts.items() if n < 2 * least_docs])
    top = found.where((F.col("n") >= least_docs) | few).select("lang", "gram").toPandas()
    return LanguageFilters.build({lang: g["gram"].to_numpy() for lang, g in top.groupby("lang")}, common=min(counts, key=lambda k: (-counts[k], k)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4; null id: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows are judged one by one from the whole text alone; cases as in :meth:`LanguageFilters.decide`. Null or repeated
    doc_id and repeated rows stay as they are. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for up to 64 languages, or 64 bytes a gram of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch["text"].is_valid().to_pylist()
            for at, texts in slices(batch["text"], 1_000_000):
                names, score = shared.value.decide([t.decode() if ok else None for t, ok in zip(texts, valid[at : at + len(texts)], strict=True)])
                yield pa.record_batch([batch["doc_id"].slice(at, len(texts)), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
