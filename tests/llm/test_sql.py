"""Registered queries against their SQL on texts with all kinds of white space, repeats, nulls and near copies."""

import collections
import random

import duckdb
import pytest

from tideframe.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéßж") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    space = [" ", " ", " ", "\n", "\r", "\v", "\f", "\t", "\r\n", "\n\n", " ", "\x1c", " ", "\x85"]
    say = lambda k: "".join(rng.choice(words) + rng.choice(space) for _ in range(k))
    passage = say(50)
    out = [None, "", " \r\v\f ", "a\rb c", "a\vb\fc", "\r", "A\rB c"]
    for _ in range(60):
        t = say(rng.randint(1, 90))
        if rng.random() < 0.3:
            t += passage + say(5)
        elif rng.random() < 0.3 and len(out) > 10:
            t = (rng.choice(out[7:]) or "").replace("a", "e", 1)
        elif rng.random() < 0.2:
            t = t.replace("\r", "\n") + "<S>"
        out.append(t)
    return out + out[10:14]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sql")
    rows = [(k, t, "en", "abcd"[k % 4] if k % 9 else None, len(t or "")) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(queries.SQL))
def test_spark_and_sql_agree(spark, folder, name):
    df = queries.QUERIES[name](spark, str(folder))
    got = collections.Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want
