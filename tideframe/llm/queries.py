"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_documents
from .bpe import encode_digest
from .fim import fill_in_middle, restore
from .langid import held_out, predict_languages, train_filters
from .licenses import scan_licenses
from .merkle import compare_with_edit
from .mixing import mix_sources
from . import minhash, suffixes, windows
from .quality import score_quality, train_field
from .simhash import near_duplicates
from .store import bound_batches
from .toxicity import score_toxicity, train_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train_filters(docs.where(~held_out(F.col("doc_id"))))
    return predict_languages(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeats(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels know poor documents and toxic ones; the chain is poor, toxic, and toxic in poor text."""
    docs = table(spark, sf_dir, "documents")
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    chain = train_toxicity(docs, table(spark, sf_dir, "labels"), {"poor": poor, "toxic": toxic, "toxic_poor": toxic & poor}, {"toxic_poor": ("toxic", "poor")})
    return score_toxicity(docs, chain)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_field(docs, table(spark, sf_dir, "labels")))


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null' || coalesce(md5(text), ''))) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE row_number() OVER (ORDER BY source ASC NULLS LAST) % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM src) - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0.0::DOUBLE))
           / ((SELECT sum(w) FROM src) - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS level
  FROM src
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT min_by(level, cap / w) AS l, min(cap / w) AS r FROM lev WHERE level <= cap / w),
tgt AS (SELECT source, source_size, CASE WHEN cap / w >= (SELECT r FROM lam) THEN (SELECT l FROM lam) * w ELSE cap END AS target FROM lev),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (floor(target)::BIGINT // source_size) * size
         + greatest(0, least(size, floor(target)::BIGINT - (floor(target)::BIGINT // source_size) * source_size - before)) END::BIGINT AS taken
FROM run
"""

_OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nx AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST),
         first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM t),
ed AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM nx),
every AS (SELECT text AS x FROM ed UNION SELECT edited FROM ed),
esc AS (SELECT x, replace(replace(x, chr(29), chr(29) || '0'), chr(30), chr(29) || '1') AS e FROM every),
leaf AS (
  SELECT x, list_transform(string_split(e, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(
    string_split(regexp_replace(array_to_string(list_transform(regexp_extract_all(p, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+'),
      lambda w: CASE WHEN substr(md5(rtrim(w, ' ')), 1, 1) IN ('0', '8') THEN w || chr(30) ELSE w END), ''), '\x1E$', ''), chr(30)),
    lambda b: sha256('b' || b)))) AS ss
  FROM esc),
para AS (SELECT x, list_transform(ss, lambda ps: list_transform(ps, lambda ls: {'node': sha256('p' || array_to_string(ls, '')), 'leaves': ls})) AS ss FROM leaf),
sect AS (SELECT x, list_transform(ss, lambda ps: {'node': sha256('s' || array_to_string(list_transform(ps, lambda p: p.node), '')), 'ps': ps}) AS ss FROM para),
fp AS (
  SELECT x, sha256('r' || array_to_string(list_transform(ss, lambda s: s.node), '')) || ':' || array_to_string(list_transform(ss, lambda s: substr(s.node, 1, 8) || '=' || array_to_string(
    list_transform(s.ps, lambda p: array_to_string(list_concat([substr(p.node, 1, 8)], list_transform(list_filter(p.leaves, lambda l: l <> sha256('b')), lambda l: substr(l, 1, 8))), ',')), ';')), '/') AS f FROM sect),
part AS (
  SELECT x, f, split_part(f, ':', 1) AS root, string_split(split_part(f, ':', 2), '/') AS secs,
         list_distinct(flatten(list_transform(flatten(list_transform(string_split(split_part(f, ':', 2), '/'), lambda s: string_split(substr(s, 10), ';'))), lambda p: string_split(p, ',')[2:]))) AS leaves
  FROM fp),
pair AS (SELECT DISTINCT a, b FROM (SELECT text AS a, edited AS b FROM ed UNION ALL SELECT text, nxt FROM ed)),
open1 AS (
  SELECT a, b, p.root = q.root AS same, len(p.leaves) + len(q.leaves) AS n,
         flatten(list_transform(list_distinct(list_filter(p.secs, lambda s: NOT list_contains(q.secs, s))), lambda s: string_split(substr(s, 10), ';'))) AS pa,
         flatten(list_transform(list_distinct(list_filter(q.secs, lambda s: NOT list_contains(p.secs, s))), lambda s: string_split(substr(s, 10), ';'))) AS pb
  FROM pair JOIN part p ON p.x = a JOIN part q ON q.x = b),
open2 AS (
  SELECT a, b, same, n, list_distinct(flatten(list_transform(list_filter(pa, lambda p: NOT list_contains(pb, p)), lambda p: string_split(p, ',')[2:]))) AS la,
         list_distinct(flatten(list_transform(list_filter(pb, lambda p: NOT list_contains(pa, p)), lambda p: string_split(p, ',')[2:]))) AS lb
  FROM open1),
near AS (
  SELECT a, b, CASE WHEN same THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(
    1.0::DOUBLE - (len(list_filter(la, lambda l: NOT list_contains(lb, l))) + len(list_filter(lb, lambda l: NOT list_contains(la, l))))::DOUBLE / n, 1.0::DOUBLE - 1.0::DOUBLE / (n + 1)) END AS v
  FROM open2)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, f.f AS fingerprint, g.f AS edited_fingerprint, u.v AS near_edited, w.v AS near_next
FROM ed e JOIN fp f ON f.x = e.text JOIN fp g ON g.x = e.edited JOIN near u ON u.a = e.text AND u.b = e.edited JOIN near w ON w.a = e.text AND w.b = e.nxt
"""

_OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, s, array_to_string(w[s:s + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
rep AS (SELECT rid, s FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS j FROM rep),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (
  SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.j) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = x.rid AND g.j = x.j) GROUP BY x.rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN lost l USING (rid) LEFT JOIN kept k USING (rid)
"""

_OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, o, s, substr(h, 2 * s + 1, 200) AS k FROM (SELECT rid, o, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d)),
rep AS (SELECT rid, s FROM (SELECT rid, o, s, min({'o': o, 's': s}) OVER (PARTITION BY k) AS f FROM win) WHERE {'o': o, 's': s} > f),
isl AS (SELECT rid, s, sum(c) OVER (PARTITION BY rid ORDER BY s) AS r FROM (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 100 THEN 0 ELSE 1 END AS c FROM rep)),
span AS (SELECT rid, min(s) AS a, max(s) + 100 AS b FROM isl GROUP BY rid, r),
cut AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM span),
lost AS (SELECT c.rid, sum(b - a) AS n, count(*) AS k, string_agg(substr(d.h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS t, max(b) AS z FROM cut c JOIN d USING (rid) GROUP BY c.rid)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE t || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN lost l USING (rid)
"""

_OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
draw AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
form AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draw),
cut AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM form)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM cut
"""

_OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
full_set AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' ')))) END AS s
  FROM d),
same AS (SELECT s, min(rid) AS rep, min(doc_id) AS least, len(s) AS n FROM full_set GROUP BY s),
one AS (SELECT rep, n, unnest(s) AS x FROM same),
link AS (
  SELECT a.rep AS u, b.rep AS v FROM one a JOIN one b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS u, rep AS v FROM same UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
comp AS (SELECT r.u AS rep, min(q.least) AS component_id FROM reach r JOIN same q ON q.rep = r.v GROUP BY r.u)
SELECT f.doc_id, len(f.s)::BIGINT AS n_shingles, CASE WHEN len(f.s) = 0 THEN f.doc_id ELSE c.component_id END AS component_id,
       coalesce(f.doc_id = CASE WHEN len(f.s) = 0 THEN f.doc_id ELSE c.component_id END, false) AS kept
FROM full_set f JOIN same q ON q.s = f.s JOIN comp c ON c.rep = q.rep
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_merkle_fingerprints": op7_merkle_fingerprints,
    "op8_quality_rules": op8_quality_rules,
    "op9_word_bpe": op9_word_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}
SQL: dict[str, str] = {"op1_mix_sources": _OP1_SQL, "op3_substring_dedup": _OP3_SQL, "op7_merkle_fingerprints": _OP7_SQL, "op10_suffix_dedup": _OP10_SQL, "op12_fill_in_middle": _OP12_SQL, "op13_minhash_near_dedup": _OP13_SQL}
