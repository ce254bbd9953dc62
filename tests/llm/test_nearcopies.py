"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import collections
import random

import numpy as np
import pytest
from test_operators import WORD, corpus

import corpus_pipeline
from tideframe.llm import nearcopies


def shingled(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [shingled(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i, s = len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])
            if 9 * i >= 4 * s and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sets, group


def family():
    """Edits of one long text, alike at 0.8 or more from one to the next, and of shorter ones."""
    rng = random.Random(4)
    say = lambda k: [f"w{rng.randint(0, 5000)}" for _ in range(k)]
    out = []
    for n in (12, 30, 150, 900):
        base = say(n)
        for _ in range(12):
            for at in rng.sample(range(n), max(1, n // 90)):
                base[at] = say(1)[0]
            out.append(" ".join(base))
    return out


@pytest.fixture(scope="module")
def rows():
    rows = [r[:5] for r in corpus(120, 11)]
    return rows + [(1000 + k, t, "en", "a", len(t)) for k, t in enumerate(family())]


@pytest.mark.parametrize("many", [2, 0])
def test_near_dedup_stage(spark, rows, many, monkeypatch):
    monkeypatch.setattr(nearcopies, "MANY", many)
    monkeypatch.setattr(nearcopies, "TILE", 16)
    sets, group = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    by_group = collections.defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        by_group[g].append(r)
    # one row of each group, of its smallest id
    assert sum(got.values()) == len(by_group)
    where = {r: g for r, g in zip(rows, group, strict=True)}
    assert {where[r] for r in got} == set(by_group)
    for r in got:
        ids = [x[0] for x in by_group[where[r]] if x[0] is not None]
        assert r[0] == (min(ids) if ids else None)


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 3, 10, 100, 400, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(n * rng.random() * 0.2) :], rng.integers(0, 1 << 63, int(n * rng.random() * 0.2)).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            wa, wb = (nearcopies.width(nearcopies.cell_of(len(x))) for x in (a, b))
            w = min(wa, wb)
            sa, sb = (nearcopies.fold(nearcopies.sketch(x, y)[None], w) for x, y in ((a, wa), (b, wb)))
            apart = int(np.bitwise_count(sa ^ sb).sum())
            assert apart <= len(a) + len(b) - 2 * i
            if 9 * i >= 4 * (len(a) + len(b)):
                assert 9 * apart <= len(a) + len(b)
