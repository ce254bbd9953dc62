"""The pipeline on a small folder against a brute-force version of its stages."""

import collections
import hashlib

import numpy as np
import pytest
from test_nearcopies import brute
from test_operators import SCHEMA, WORD, corpus

import corpus_pipeline
from tideframe.llm import quality


def _keep_bytes(texts, width=100):
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = True
            seen.add(w)
        out[d] = (bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"), bool(gone.any()))
    return {d: t for d, (t, cut) in out.items() if not cut or t.strip(" ")}


def _copies(texts, source):
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    total = collections.Counter()
    for d in texts:
        total[source[d]] += size[d]
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    out = {}
    for s in total:
        budget = int(np.floor(target[s] + 1e-9))
        whole, before = divmod(budget, total[s])[0] if total[s] else 0, 0
        for d in sorted((d for d in texts if source[d] == s), key=lambda d: hashlib.md5(f"mix:{d}".encode()).hexdigest()):
            left = budget - whole * total[s] - before
            out[d] = whole + (2 * left >= size[d]) if size[d] else 1
            before += size[d]
    return out


def test_stages(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [r for r in {r[0]: r for r in corpus(120, 11) if r[0] is not None}.values()]
    rows = [(k, (t + " #### $$$$ %%%%" * 30 if k % 9 == 0 and t else t), *rest) for k, t, *rest in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 9 != 0), 0) for r in rows if r[0] % 2 == 0 or r[0] % 9 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    field = quality.train_field(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score_quality(d, field).where("kept").collect()}
    texts = {r[0]: r[1] for r in rows if r[0] in kept}
    assert 20 < len(texts) < len(rows)

    ids = sorted(texts)
    _, group = brute([(k, texts[k]) for k in ids])
    first = {}
    for k, g in zip(ids, group, strict=True):
        first.setdefault(g, k)
    texts = _keep_bytes({k: texts[k] for k in first.values()})
    copies = _copies(texts, {r[0]: r[3] for r in rows})
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        if copies[k]:
            want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += copies[k]
    assert got == want


def test_stages_keep_the_columns_of_documents():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_dedup", "mixing", "bpe_tokens"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_tells_rows_of_one_id_apart(spark):
    rows = [(None if k % 3 else 5, f"w{k} " * (1 + k % 7), "en", "ab"[k % 2], k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.mixing(spark, docs, "").collect())
    total, taken = collections.Counter(), collections.Counter()
    for r in rows:
        total[r[3]] += len(r[1].split())
    for r, n in got.items():
        taken[r[3]] += n * len(r[1].split())
    assert set(got) <= set(rows) and max(got.values()) <= 2
    full = 1.5 * (total["a"] + total["b"])
    a = min(5 / 7 * full, 2 * total["a"])
    assert abs(taken["a"] - a) <= 7 and abs(taken["b"] - (full - a)) <= 7
    assert got == collections.Counter(tuple(r) for r in corpus_pipeline.mixing(spark, docs.repartition(5), "").collect())
