"""The registered slugify query takes whole texts."""

import re

from tideframe.plans import catalog


def python_slug(t):
    return re.sub(r"^-+|-+$", "", re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", (t or "").strip().lower()))) or "item"


def test_slugify_takes_whole_texts(spark, tmp_path):
    texts = [None, "", "?!\n...", "One line", "First line\nSecond, line!\n\n third_line ", "\n\nÉté à vivre\r\n  снег\tи лёд\n", "a\n" * 500 + "end", "x-\n-y", "\n_\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["slug"] for r in catalog.slugify(spark, str(tmp_path)).collect()}
    assert got == {k: python_slug(t) for k, t in enumerate(texts)}
    assert got[4] == "first-line-second-line-third-line"
