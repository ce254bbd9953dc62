"""MinHash near-dedup against all pairs of sets."""

import collections
import random

import numpy as np
import pytest
from test_nearcopies import shingled
from test_operators import SCHEMA, corpus

from tideframe.llm import minhash, nearcopies


def by_hand(rows):
    sets, parent = [shingled(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    having = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    for a in range(len(rows)):
        for b, i in collections.Counter(b for x in sets[a] for b in having[x] if b < a).items():
            if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    of = [least.get(root(k)) if s else rows[k][0] for k, s in enumerate(sets)]
    return collections.Counter((r[0], len(s), c, r[0] is not None and r[0] == c) for r, s, c in zip(rows, sets, of, strict=True))


def families():
    """Edits of texts near the threshold, chains of edits, and texts that share a passage and little else."""
    rng = random.Random(7)
    say = lambda k: [f"w{rng.randint(0, 3000)}" for _ in range(k)]
    texts = []
    for n in (12, 40, 150, 500):
        for _ in range(2):
            base = now = say(n)
            for _ in range(14):
                t = list(rng.choice([base, now]))
                for at in rng.sample(range(n), max(1, int(n * rng.choice([0.005, 0.012, 0.016, 0.02, 0.03])))):
                    t[at] = say(1)[0]
                now = rng.choice([now, t])
                texts.append(" ".join(t))
    passage = say(120)
    texts += [" ".join(say(rng.randint(5, 25)) + passage + say(rng.randint(5, 25))) for _ in range(40)]
    return texts + ["", None, " ", "a b", "A b", "a b c d e", "a b c d e f"] * 2


@pytest.fixture(scope="module")
def rows():
    rows = [(k, t, None, "s", 0, 1, 2, "fp", 3) for k, t in enumerate(families())]
    return [*rows, *((2000 + r[0] if r[0] is not None else None, *r[1:]) for r in corpus(30, 8)), (None, rows[3][1], *rows[0][2:]), (5, "zz yy", *rows[0][2:]), (None, None, *rows[0][2:])]


@pytest.mark.parametrize("many, turns, small, tile", [(0.25, 4, 32, 4096), (0, 0, 2, 8), (0, 2, 2, 50)])
def test_components(spark, rows, monkeypatch, many, turns, small, tile):
    """Also with buckets cut in many tiles, forests only, and tiles that are settled on the sets."""
    for module, name, value in ((nearcopies, "MANY", many), (nearcopies, "TURNS", turns), (nearcopies, "PART_BYTES", 1 << 14), (minhash, "SMALL", small), (minhash, "TILE", tile)):
        monkeypatch.setattr(module, name, value)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collections.Counter(map(tuple, minhash.near_duplicates(docs).collect())) == by_hand(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    for n in (8, 30, 160, 2000):
        same, share = [], 0.8
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n)).astype(np.uint64)])
            same.append((minhash.signature(a) == minhash.signature(b)).mean())
        i = int(share * n)
        assert abs(np.mean(same) - i / (2 * n - i)) < 0.06


def test_similar_sets_share_a_bucket():
    rng = np.random.default_rng(1)
    for n in (7, 12, 40, 300):
        for _ in range(150):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            k = int(2 * n * 0.15 / 1.85 / 2)  # as many as may differ on each side
            b = np.concatenate([a[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])
            assert (minhash.bands(a) == minhash.bands(b)).any()
