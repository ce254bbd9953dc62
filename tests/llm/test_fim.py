"""Fill-in-the-middle documents against the pattern itself."""

import hashlib
import random
import re

from test_operators import SCHEMA, corpus

from pyspark.sql import functions as F

from tideframe.llm import fim, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
BITS = ["a", "B", "é", "<P>", "<", "S>", " ", "\n", "9", "zz", "\U0001f600", "\x00", "ſ", "<M", "\r"]


def by_hand(doc_id, text, plain=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_and_places():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))
        units, counted = UNIT.findall(text), fim.Units(text, rng.choice([1, 2, 3, 5, 100]))
        assert counted.count == len(units) and counted.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
        for k in (0, rng.randint(0, len(units)), len(units)):
            assert counted.place(k) == len("".join(units[:k]))


def test_long_texts():
    text = "word, " * 200_000 + "x" * 700_000 + "é" * 300_000
    units = fim.Units(text)
    assert units.count == 600_000 + 1 + 300_000
    assert [units.place(k) for k in (3, 600_000, 600_001, 600_002)] == [6, 1_200_000, 1_900_000, 1_900_001]


def test_documents(spark):
    rng = random.Random(2)
    rows = corpus(200, 3) + [(1000 + k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))), None, None, 0, 0, 0, None, 0) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fim.fill_in_middle(docs, most=500)
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == sorted((by_hand(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restore(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(k, f"alpha {k} beta <{k}> gamma", "x") for k in range(40)] + [(None, None, "y"), (7, "alpha 7", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(((*by_hand(r[0], r[1])[:5], sha(by_hand(r[0], r[1])[5]), sha(r[1] or "")) for r in rows), key=repr)
