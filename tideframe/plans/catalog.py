"""Registered queries over the driver's tables, and the SQL they equal.

Vectors of ``embeddings`` stand for frames (a label is a recording), users of ``events`` for recordings that scroll by the
change of ``value``, texts and urls for transcripts and files. Vectors are unrelated to their label, so the distances that
cut and merge are larger than a screen recording's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import numbers, text
from ..operators import images, registry
from ..operators import pairs as P
from ..operators import segments as G
from ..operators import states as S
from . import views

FLAGSHIP = "build_states"
CONFIG = Config(cut_distance=1.0, merge_distance=0.8, scroll_min_shift_px=20.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "embeddings").select(text.padded_id("rec", F.col("label") + 1, 2).alias("recording_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    idx = (F.row_number().over(Window.partitionBy("recording_id").orderBy("vec_id")) - 1).cast("int")
    return rows.withColumn("idx", idx).select("recording_id", "idx", numbers.frame_time(F.col("idx") + 1, CONFIG.sample_fps).alias("ts"), "vec")


def _shifts(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.row_number().over(w) - 1).cast("int").alias("idx"), (F.lead("value").over(w) - F.col("value")).alias("dy"))
    return rows.where(F.col("dy").isNotNull()).withColumns({"dx": F.lit(0.0), "response": F.lit(1.0)})


def _islands(spark: SparkSession, sf: str) -> DataFrame:
    frames = _frames(spark, sf)
    none = spark.createDataFrame([], "recording_id string, start_idx int, end_idx int, direction int")
    return P.cut_islands(frames, P.classify_pairs(P.frame_pairs(frames), none, CONFIG))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    segments = G.segment_recordings(_frames(spark, sf), None, CONFIG)
    return S.labelled_segments(segments, CONFIG.merge_distance)


def _segment_like_rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.segment_stats(_islands(spark, sf))


_FRAMES = """
fr AS (
  SELECT printf('rec_%02d', label + 1) AS recording_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS idx,
         (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::DOUBLE AS ts, embedding::DOUBLE[] AS vec
  FROM embeddings),
pd AS (
  SELECT recording_id, idx, 1 - list_inner_product(vec, nxt) AS dist
  FROM (SELECT *, lead(vec) OVER (PARTITION BY recording_id ORDER BY idx) AS nxt FROM fr) WHERE nxt IS NOT NULL),
isl AS (
  SELECT fr.*, coalesce(sum(CASE WHEN pd.dist > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY fr.recording_id ORDER BY fr.idx), 0)::INT AS seg_no
  FROM fr LEFT JOIN pd ON pd.recording_id = fr.recording_id AND pd.idx = fr.idx - 1),
mean AS (
  SELECT recording_id, seg_no, list(m ORDER BY pos) AS mean FROM (
    SELECT recording_id, seg_no, pos, avg(x) AS m FROM (
      SELECT recording_id, seg_no, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM isl) GROUP BY ALL) GROUP BY ALL),
cen AS (SELECT recording_id, seg_no, list_transform(mean, lambda x: x / sqrt(list_inner_product(mean, mean))) AS centroid FROM mean),
near AS (SELECT isl.*, centroid, 1 - list_inner_product(centroid, vec) AS d FROM isl JOIN cen USING (recording_id, seg_no)),
seg AS (
  SELECT recording_id, seg_no, min(idx) AS start_idx, max(idx) AS end_idx, min(ts) AS start_time, max(ts) AS end_time,
         arg_min(idx, {'d': d, 'i': idx}) AS rep_idx, any_value(centroid) AS centroid, greatest(least(1 - avg(d), 1), 0) AS confidence
  FROM near GROUP BY recording_id, seg_no)"""

_FOLDS = """,
kept AS (
  SELECT recording_id, seg_no, start_idx, end_idx, centroid, centroid AS prev, true AS keep FROM seg WHERE seg_no = 0
  UNION ALL
  SELECT recording_id, seg_no, start_idx, end_idx, centroid, CASE WHEN keep THEN centroid ELSE prev END, keep FROM (
    SELECT s.*, k.prev, n.seg_no IS NULL OR NOT (n.start_time - s.start_time < 1.5 AND 1 - list_inner_product(k.prev, n.centroid) <= 1.0) AS keep
    FROM kept k JOIN seg s ON s.recording_id = k.recording_id AND s.seg_no = k.seg_no + 1
    LEFT JOIN seg n ON n.recording_id = s.recording_id AND n.seg_no = s.seg_no + 1)),
num AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_no) AS k FROM kept WHERE keep),
pos AS (SELECT recording_id, idx, unnest(vec) AS x, unnest(range(len(vec))) AS p FROM fr),
run AS (SELECT recording_id, idx, p, sum(x) OVER (PARTITION BY recording_id, p ORDER BY idx) AS s FROM pos),
pre AS (SELECT recording_id, idx, list(s ORDER BY p) AS s FROM run GROUP BY ALL),
mrg AS (
  SELECT recording_id, k, start_idx, end_idx, centroid, 0 AS g FROM num WHERE k = 1
  UNION ALL
  SELECT recording_id, k, start_idx, end_idx, CASE WHEN m THEN list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) ELSE centroid END, g + (CASE WHEN m THEN 0 ELSE 1 END) FROM (
    SELECT n.recording_id, n.k, m.g, n.end_idx, n.centroid, 1 - list_inner_product(m.centroid, n.centroid) <= 0.8 AS m,
           CASE WHEN 1 - list_inner_product(m.centroid, n.centroid) <= 0.8 THEN m.start_idx ELSE n.start_idx END AS start_idx,
           CASE WHEN a.s IS NULL THEN b.s ELSE list_transform(list_zip(b.s, a.s), lambda z: z[1] - z[2]) END AS c
    FROM mrg m JOIN num n ON n.recording_id = m.recording_id AND n.k = m.k + 1
    JOIN pre b ON b.recording_id = n.recording_id AND b.idx = n.end_idx
    LEFT JOIN pre a ON a.recording_id = n.recording_id AND a.idx = m.start_idx - 1)),
fin AS (SELECT recording_id, g::INT AS seg_no, min(start_idx) AS start_idx, max(end_idx) AS end_idx, arg_max(centroid, k) AS centroid FROM mrg GROUP BY recording_id, g),
inr AS (SELECT f.*, r.idx, r.ts, 1 - list_inner_product(f.centroid, r.vec) AS d FROM fin f JOIN fr r ON r.recording_id = f.recording_id AND r.idx BETWEEN f.start_idx AND f.end_idx),
sg AS (
  SELECT recording_id, seg_no, any_value(start_idx) AS start_idx, any_value(end_idx) AS end_idx, min(ts) AS start_time, max(ts) AS end_time, arg_min(idx, {'d': d, 'i': idx}) AS rep_idx,
         any_value(centroid) AS centroid, greatest(least(1 - avg(d), 1), 0) AS confidence
  FROM inr GROUP BY recording_id, seg_no),
fl AS (SELECT *, (row_number() OVER (ORDER BY recording_id, seg_no) - 1)::INT AS flat_no FROM sg),
cl AS (
  SELECT 0 AS flat_no, [centroid] AS cs, 0 AS label FROM fl WHERE flat_no = 0
  UNION ALL
  SELECT flat_no, CASE WHEN label = len(cs) THEN list_append(cs, centroid) ELSE list_transform(cs, lambda c, i: CASE WHEN i = label + 1
           THEN list_transform(list_zip(c, centroid), lambda z: (z[1] + z[2]) / sqrt(list_inner_product(c, c) + 2 * list_inner_product(c, centroid) + list_inner_product(centroid, centroid))) ELSE c END) END, label
  FROM (SELECT f.flat_no, f.centroid, cs, CASE WHEN list_min(ds) <= 0.8 THEN list_position(ds, list_min(ds)) - 1 ELSE len(cs) END::INT AS label
        FROM (SELECT f.flat_no, f.centroid, c.cs, list_transform(c.cs, lambda x: 1 - list_inner_product(x, f.centroid)) AS ds FROM cl c JOIN fl f ON f.flat_no = c.flat_no + 1) f)),
lab AS (SELECT fl.*, cl.label, printf('state_%04d', cl.label + 1) AS state_id FROM fl JOIN cl USING (flat_no)),
occ AS (
  SELECT l.state_id, l.label, l.recording_id, l.flat_no, round_even(l.start_time, 2) AS start, round_even(l.end_time, 2) AS "end", round_even(r.ts, 2) AS representative_timestamp, round_even(l.confidence, 3) AS confidence,
         printf('%02d:%02d:%02d', l.start_time::BIGINT // 3600, l.start_time::BIGINT % 3600 // 60, l.start_time::BIGINT % 60) AS start_tc,
         printf('%02d:%02d:%02d', l.end_time::BIGINT // 3600, l.end_time::BIGINT % 3600 // 60, l.end_time::BIGINT % 60) AS end_tc
  FROM lab l JOIN fr r ON r.recording_id = l.recording_id AND r.idx = l.rep_idx),
nx AS (SELECT *, lead(state_id) OVER w AS to_state, lead(start_time) OVER w AS at_s, lead(flat_no) OVER w AS to_no, lead(rep_idx) OVER w AS to_rep FROM lab WINDOW w AS (PARTITION BY recording_id ORDER BY start_time, seg_no)),
tr AS (SELECT printf('trans_%04d', row_number() OVER (ORDER BY recording_id, to_no)) AS id, recording_id, state_id AS from_state, to_state, at_s FROM nx WHERE to_state <> state_id)"""

_SEG = "WITH" + _FRAMES
_ALL = "WITH RECURSIVE" + _FRAMES + _FOLDS


@query(_SEG + " SELECT recording_id, idx, round(dist, 6) AS dist FROM pd")
def pair_distance(spark, sf):
    return P.frame_pairs(_frames(spark, sf)).withColumn("dist", F.round("dist", 6))


@query(_SEG + " SELECT recording_id, idx, CASE WHEN dist > 1.0 THEN 'cut' ELSE 'static' END AS kind FROM pd")
def pair_class(spark, sf):
    none = spark.createDataFrame([], "recording_id string, start_idx int, end_idx int, direction int")
    return P.classify_pairs(P.frame_pairs(_frames(spark, sf)), none, CONFIG).drop("dist")


@query(_SEG + " SELECT recording_id, idx, ts, seg_no FROM isl")
def cut_segments(spark, sf):
    return _islands(spark, sf).drop("vec")


@query(_SEG + " SELECT recording_id, seg_no, p::INT AS pos, round(x, 6) AS x FROM (SELECT recording_id, seg_no, unnest(centroid) AS x, unnest(range(len(centroid))) AS p FROM cen)")
def segment_centroid(spark, sf):
    return G.segment_centroids(_islands(spark, sf)).select("recording_id", "seg_no", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(_SEG + " SELECT recording_id, seg_no, start_idx, end_idx, start_time, end_time, rep_idx FROM seg")
def segment_representative(spark, sf):
    return _segment_like_rows(spark, sf).drop("centroid", "confidence")


@query(_SEG + " SELECT recording_id, seg_no, round(confidence, 6) AS confidence FROM seg")
def segment_confidence(spark, sf):
    return _segment_like_rows(spark, sf).select("recording_id", "seg_no", F.round("confidence", 6).alias("confidence"))


@query(
    _SEG
    + """, nxt AS (SELECT recording_id, idx, lead(ts) OVER w AS after, ts - lag(ts) OVER w AS step FROM fr WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
    SELECT s.recording_id, s.seg_no, coalesce(after - start_time, greatest(end_time - start_time, coalesce(step, 0))) AS duration
    FROM seg s JOIN nxt n ON n.recording_id = s.recording_id AND n.idx = s.end_idx"""
)
def segment_duration(spark, sf):
    islands = _islands(spark, sf)
    return G.segment_durations(G.segment_stats(islands), islands).select("recording_id", "seg_no", "duration")


@query(_ALL + " SELECT recording_id, (k - 1)::INT AS seg_no, start_idx, end_idx FROM num")
def drop_transient(spark, sf):
    return G.segment_ranges(_islands(spark, sf), CONFIG, merge=False).select("recording_id", "seg_no", "start_idx", "end_idx")


@query(_ALL + " SELECT recording_id, seg_no, start_idx, end_idx, rep_idx, round(confidence, 6) AS confidence FROM sg")
def merge_adjacent(spark, sf):
    return G.fold_segments(_islands(spark, sf), CONFIG).select("recording_id", "seg_no", "start_idx", "end_idx", "rep_idx", F.round("confidence", 6).alias("confidence"))


@query(_ALL + " SELECT flat_no, label FROM lab")
def greedy_cluster(spark, sf):
    return _labelled(spark, sf).select("flat_no", "label")


@query(_ALL + " SELECT recording_id, seg_no, start_idx, end_idx, rep_idx, round(confidence, 6) AS confidence, state_id, false AS is_scroll FROM lab")
def build_states(spark, sf):
    """The flagship: vectors to segments to states shared by all recordings."""
    return _labelled(spark, sf).select("recording_id", "seg_no", "start_idx", "end_idx", "rep_idx", F.round("confidence", 6).alias("confidence"), "state_id", "is_scroll")


@query(_ALL + " SELECT state_id, arg_max(flat_no, {'c': confidence, 'f': -flat_no}) AS flat_no FROM lab GROUP BY state_id")
def canonical_member(spark, sf):
    return S.canonical_members(_labelled(spark, sf)).select("state_id", "canonical.flat_no")


@query(_ALL + ' SELECT state_id, recording_id, start, "end", start_tc, end_tc, representative_timestamp, confidence FROM occ')
def occurrences(spark, sf):
    return S.occurrences(_labelled(spark, sf), _frames(spark, sf)).drop("label", "flat_no")


@query(_ALL + " SELECT state_id AS id, 'screen' AS kind, count(*) AS n, min(start_tc) AS first_tc, string_agg(recording_id || ' ' || start_tc || ' ' || end_tc, '; ' ORDER BY recording_id, start, flat_no) AS spans FROM occ GROUP BY state_id")
def shared_states(spark, sf):
    """States with their occurrences in order, written in a row."""
    rows = S.states(S.occurrences(_labelled(spark, sf), _frames(spark, sf)))
    spans = F.concat_ws("; ", F.transform("occurrences", lambda o: F.concat_ws(" ", o["recording_id"], o["start_tc"], o["end_tc"])))
    return rows.select("id", "kind", F.size("occurrences").cast("long").alias("n"), F.array_min(F.transform("occurrences", lambda o: o["start_tc"])).alias("first_tc"), spans.alias("spans"))


_TC = "printf('%02d:%02d:%02d', {0}::BIGINT // 3600, {0}::BIGINT % 3600 // 60, {0}::BIGINT % 60)"


@query(
    _ALL
    + f""" SELECT id, recording_id, from_state, to_state, round_even(at_s, 2) AS "at", {_TC.format('at_s')} AS at_tc, 'unknown' AS kind, 0.3::DOUBLE AS confidence FROM tr"""
)
def transitions(spark, sf):
    return S.transitions(S.state_changes(_labelled(spark, sf)))


@query(_ALL + " SELECT from_state, to_state, count(*) AS n FROM tr GROUP BY ALL")
def workflow_graph(spark, sf):
    return S.workflow_graph(S.transitions(S.state_changes(_labelled(spark, sf))))


def _recordings(spark, sf):
    """Recordings of the frames, and one without any."""
    rows = _frames(spark, sf).groupBy(F.col("recording_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("duration"))
    return rows.unionByName(spark.createDataFrame([("rec_99", 0.0)], "id string, duration double")).withColumn("filename", F.concat("id", F.lit(".mp4")))


@query(
    _ALL
    + f""", recs AS (SELECT recording_id AS id, count(*)::DOUBLE AS duration FROM fr GROUP BY 1 UNION ALL SELECT 'rec_99', 0.0)
    SELECT r.id AS recording_id, r.id || '.mp4' AS filename, duration, {_TC.format('duration')} AS duration_tc,
      CASE WHEN o.state_id IS NOT NULL THEN (row_number() OVER (PARTITION BY r.id ORDER BY o.start, o.label) - 1)::INT END AS event_no,
      o.start_tc AS timestamp, o.start AS seconds, o.state_id, o.state_id AS event, CASE WHEN o.state_id IS NOT NULL THEN 'screen' END AS kind, o.confidence
    FROM recs r LEFT JOIN occ o ON o.recording_id = r.id"""
)
def timeline(spark, sf):
    return views.timeline_events(_recordings(spark, sf), S.occurrences(_labelled(spark, sf), _frames(spark, sf)))


@query(
    _ALL
    + """ SELECT state_id, state_id AS label, 'screen' AS kind, count(*) AS occurrences, count(DISTINCT recording_id) AS recordings, round_even(sum(greatest("end" - start, 0)), 1) AS total_seconds,
      min(start_tc) AS first_seen, 'screenshots/' || state_id || '.png' AS screenshot FROM occ GROUP BY state_id"""
)
def state_summary(spark, sf):
    return views.state_summary(S.states(S.occurrences(_labelled(spark, sf), _frames(spark, sf))))


@query(_ALL + " SELECT recording_id, (SELECT count(*) FROM fr WHERE fr.recording_id = s.recording_id) AS frames_sampled, count(*) AS segments FROM sg s GROUP BY recording_id")
def recording_counts(spark, sf):
    return views.recording_counts(_frames(spark, sf), G.segment_recordings(_frames(spark, sf), None, CONFIG))


@query(
    _ALL
    + """ SELECT (SELECT count(DISTINCT recording_id) FROM fr) AS recordings_processed, (SELECT count(*)::BIGINT FROM fr) AS frames_sampled, (SELECT count(*)::BIGINT FROM sg) AS segments,
      (SELECT count(DISTINCT label) FROM cl) AS states, 0::BIGINT AS scroll_states, (SELECT count(*) FROM tr) AS transitions,
      round_even(1 - (SELECT count(DISTINCT label) FROM cl) / (SELECT count(*) FROM sg), 3) AS dedup_ratio"""
)
def build_report(spark, sf):
    labelled = _labelled(spark, sf)
    counts = views.recording_counts(_frames(spark, sf), labelled)
    return views.build_report(counts, S.states(S.occurrences(labelled, _frames(spark, sf))), S.state_changes(labelled))


_SHIFTS = """
sh AS (
  SELECT user_id::VARCHAR AS recording_id, (row_number() OVER w - 1)::INT AS idx, lead(value) OVER w - value AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sg AS (SELECT recording_id, idx, dy, CASE WHEN abs(dy) >= 20 THEN CASE WHEN dy > 0 THEN 1 ELSE -1 END ELSE 0 END AS s FROM sh WHERE dy IS NOT NULL),
ch AS (SELECT *, CASE WHEN lag(s) OVER w IS DISTINCT FROM s THEN 1 ELSE 0 END AS c FROM sg WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) AS r FROM ch),
runs AS (SELECT recording_id, min(idx)::INT AS start_idx, (max(idx) + 1)::INT AS end_idx, any_value(s)::INT AS direction FROM rn WHERE s <> 0 GROUP BY recording_id, r HAVING count(*) >= 2)"""


@query("WITH" + _SHIFTS + " SELECT * FROM runs")
def scroll_runs(spark, sf):
    return P.scroll_runs(_shifts(spark, sf), CONFIG)


@query("WITH" + _SHIFTS + " SELECT DISTINCT recording_id, unnest(range(start_idx, end_idx))::INT AS idx FROM runs")
def scroll_pairs(spark, sf):
    runs = P.scroll_runs(_shifts(spark, sf), CONFIG)
    return runs.select("recording_id", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("idx")).distinct()


def _state_runs(spark, sf):
    """Runs of one event type, as segments: a cut is where the type changes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf, "events").withColumns({"idx": (F.row_number().over(w) - 1).cast("int"), "_to": F.lead("event_type").over(w)}).withColumn("recording_id", F.col("user_id").cast("string"))
    kinds = rows.where("_to IS NOT NULL").select("recording_id", "idx", F.when(F.col("_to") == F.col("event_type"), "static").otherwise("cut").alias("kind"))
    islands = P.cut_islands(rows.select("recording_id", "idx", "event_type"), kinds)
    return islands.groupBy("recording_id", "seg_no").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("event_type").alias("event_type"))


_STATE_RUNS = """
ev AS (SELECT user_id::VARCHAR AS recording_id, event_type, (row_number() OVER w - 1)::INT AS idx, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
es AS (SELECT *, (sum(c) OVER (PARTITION BY recording_id ORDER BY idx) - 1)::INT AS seg_no FROM ev),
er AS (SELECT recording_id, seg_no, min(idx) AS start_idx, max(idx) AS end_idx, min(event_type) AS event_type FROM es GROUP BY recording_id, seg_no)"""


@query("WITH" + _STATE_RUNS + " SELECT * FROM er")
def state_runs(spark, sf):
    return _state_runs(spark, sf)


@query(
    "WITH" + _STATE_RUNS + "," + _SHIFTS
    + """ SELECT e.recording_id, e.seg_no, b.start_idx IS NOT NULL AS is_scroll, b.start_idx AS scroll_start_idx, b.end_idx AS scroll_end_idx FROM er e LEFT JOIN (
      SELECT e.recording_id, e.seg_no, r.start_idx, r.end_idx, row_number() OVER (PARTITION BY e.recording_id, e.seg_no ORDER BY r.end_idx - r.start_idx DESC, r.start_idx) AS n
      FROM er e JOIN runs r ON r.recording_id = e.recording_id AND r.start_idx >= e.start_idx AND r.end_idx <= e.end_idx) b
    ON b.n = 1 AND b.recording_id = e.recording_id AND b.seg_no = e.seg_no"""
)
def run_in_segment(spark, sf):
    return G.annotate_scroll(_state_runs(spark, sf), P.scroll_runs(_shifts(spark, sf), CONFIG)).select("recording_id", "seg_no", "is_scroll", "scroll_start_idx", "scroll_end_idx")


@query("WITH" + _SHIFTS + " SELECT recording_id, CASE WHEN sum(round(dy, 3)::DECIMAL(18,3)) >= 0 THEN 1 ELSE -1 END::INT AS direction FROM sh WHERE dy IS NOT NULL GROUP BY 1")
def run_direction(spark, sf):
    total = F.sum(F.round("dy", 3).cast("decimal(18,3)"))
    return _shifts(spark, sf).groupBy("recording_id").agg(P.direction(total).cast("int").alias("direction"))


@query(
    "WITH" + _SHIFTS
    + """, way AS (SELECT recording_id, CASE WHEN sum(dy) >= 0 THEN 1 ELSE -1 END AS d FROM sh GROUP BY 1),
    st AS (SELECT recording_id, 100 + sum(least(round_even(abs(dy), 0)::BIGINT, 100)) OVER (PARTITION BY recording_id ORDER BY idx * d) AS h FROM sh JOIN way USING (recording_id) WHERE dy IS NOT NULL)
    SELECT recording_id, coalesce(min(CASE WHEN h >= 2000 THEN h END), max(h))::BIGINT AS height FROM st GROUP BY recording_id"""
)
def stitched_height(spark, sf):
    """Events of a user as the frames of a run, 100 rows high each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.row_number().over(w) - 1).cast("int").alias("idx"), (F.lead("value").over(w) - F.col("value")).alias("dy"), F.lit(100).alias("height"))
    return P.stitch_plan(frames, "recording_id", 2000).groupBy("recording_id").agg(F.max("total").alias("height"))


@query(
    """SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS tc FROM (SELECT event_id, greatest(round_even(value * 37.5 - 100, 0), 0)::BIGINT AS s FROM events)"""
)
def timecode(spark, sf):
    return _read(spark, sf, "events").select("event_id", text.timecode(F.col("value") * 37.5 - 100).alias("tc"))


@query("SELECT event_id, (event_id % 5000 - 1 + 1) / 2.0::DOUBLE AS ts FROM events")
def frame_timestamp(spark, sf):
    return _read(spark, sf, "events").select("event_id", numbers.frame_time(F.col("event_id") % 5000 + 1, 2.0).alias("ts"))


@query("SELECT event_id, round_even(value, 1) AS r1, round_even(value, 2) AS r2, round_even(value, 3) AS r3, greatest(least(value / 100, 1), 0) AS c FROM events")
def round_and_clamp(spark, sf):
    v = F.col("value")
    return _read(spark, sf, "events").select("event_id", *[numbers.rounded(v, k).alias(f"r{k}") for k in (1, 2, 3)], numbers.clamp01(v / 100).alias("c"))


@query(
    """SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[^\\p{L}\\p{M}\\p{N}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug
    FROM (SELECT doc_id, text AS t FROM documents)"""
)
def slugify(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("SELECT item_id, substr(sha1(text), 1, 8) AS h8, substr(sha1(text), 1, 12) AS h12 FROM benchmark")
def short_hash(spark, sf):
    return _read(spark, sf, "benchmark").select("item_id", text.short_hash(F.col("text")).alias("h8"), text.short_hash(F.col("text"), 12).alias("h12"))


_NAMES = "CASE c_custkey % 7 WHEN 0 THEN 'a/Take ' || c_custkey || '.MP4' WHEN 1 THEN 'b.d/notes.md' WHEN 2 THEN 'x.xyz' WHEN 3 THEN 'plain' WHEN 4 THEN '/root/p/c.webm' WHEN 5 THEN 'talk.VTT' ELSE '/root/pp/d.tar.mov' END"


@query(
    f"""SELECT c_custkey, kind_ext AS ext, CASE WHEN kind_ext IN ('mp4','mov','mkv','avi','webm','m4v') THEN 'recording' WHEN kind_ext IN ('txt','md','json','vtt','srt') THEN 'transcript' END AS kind
    FROM (SELECT c_custkey, lower(regexp_extract({_NAMES}, '[^/.][^/]*\\.([^./]+)$', 1)) AS kind_ext FROM customer)"""
)
def file_kind(spark, sf):
    name = F.expr(_NAMES)
    return _read(spark, sf, "customer").select("c_custkey", text.extension(name).alias("ext"), text.file_kind(name).alias("kind"))


@query(
    f"""SELECT c_custkey, CASE WHEN starts_with(n, '/root/p/') THEN substr(n, 9) ELSE n END AS rel, CASE WHEN starts_with(n, '/') THEN n ELSE '/root/p/' || n END AS full_path FROM (SELECT c_custkey, {_NAMES} AS n FROM customer)"""
)
def rel_path(spark, sf):
    name, root = F.expr(_NAMES), F.lit("/root/p")
    return _read(spark, sf, "customer").select("c_custkey", text.relative_path(name, root).alias("rel"), text.resolved_path(name, root).alias("full_path"))


@query("SELECT c_custkey, printf('rec_%02d', c_custkey) AS rec, printf('state_%04d', c_custkey) AS state, try_cast(nullif(regexp_extract(printf('/x/frame_%06d.png', c_custkey), 'frame_(\\d+)\\.png$', 1), '') AS INT) AS frame FROM customer")
def padded_ids(spark, sf):
    k = F.col("c_custkey")
    return _read(spark, sf, "customer").select("c_custkey", text.padded_id("rec", k, 2).alias("rec"), text.padded_id("state", k, 4).alias("state"), text.frame_number(F.format_string("/x/frame_%06d.png", k)).alias("frame"))


_FRACTION = "CASE c_custkey % 5 WHEN 0 THEN c_custkey || '000/1001' WHEN 1 THEN '0/0' WHEN 2 THEN 'abc' WHEN 3 THEN c_custkey || '/7' ELSE '25' END"


@query(
    f"""SELECT c_custkey, coalesce(CASE WHEN len(p) = 2 AND try_cast(p[2] AS DOUBLE) <> 0 THEN round_even(try_cast(p[1] AS DOUBLE) / try_cast(p[2] AS DOUBLE), 3) END, 0.0) AS fps
    FROM (SELECT c_custkey, string_split({_FRACTION}, '/') AS p FROM customer)"""
)
def parse_fraction(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", numbers.parse_fraction(F.expr(_FRACTION)).alias("fps"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END, ''), '-') AS shown FROM customer")
def optional_display(spark, sf):
    k = F.col("c_custkey") % 3
    return _read(spark, sf, "customer").select("c_custkey", text.display(F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.col("c_mktsegment"))).alias("shown"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F'")
def unprocessed(spark, sf):
    """Recordings to process: orders stand for recordings."""
    return registry.unprocessed(_read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "processed").otherwise(F.col("o_orderstatus")).alias("status")))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_transcript(spark, sf):
    return registry.without(_read(spark, sf, "documents"), _read(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def registered_twice(spark, sf):
    orders = _read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return registry.known_already(_read(spark, sf, "customer"), orders, "c_custkey").select("c_custkey", "c_name")


_TARGET = "CASE WHEN o_orderkey % 2 = 0 THEN printf('%d', o_custkey % 25) WHEN o_orderkey % 3 = 0 THEN 'none' ELSE printf('NATION_%d', o_orderkey % 25) END"


@query(
    f"""SELECT o_orderkey, coalesce(a.n_nationkey, b.n_nationkey) AS target FROM (SELECT o_orderkey, {_TARGET} AS t FROM orders) o
    LEFT JOIN nation a ON a.n_nationkey::VARCHAR = o.t LEFT JOIN (SELECT n_name, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1) b ON b.n_name = o.t"""
)
def assoc_precedence(spark, sf):
    """A target names an id first, a file name second."""
    recordings = _read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("filename"))
    rows = _read(spark, sf, "orders").select("o_orderkey", F.expr(_TARGET.replace("printf(", "format_string(")).alias("t"))
    return registry.resolve_targets(rows, "t", recordings).select("o_orderkey", F.col("recording").alias("target"))


_FILES = """SELECT '/root/' || CASE WHEN c_custkey % 2 = 0 THEN 'p' ELSE 'pp' END || '/' || printf('%06d', c_custkey) || '/' || CASE c_custkey % 5 WHEN 0 THEN 'take.MP4' WHEN 1 THEN 'notes.md' WHEN 2 THEN 'x.xyz'
  WHEN 3 THEN printf('t%d.webm', c_custkey) ELSE 'talk.VTT' END AS path, c_custkey::BIGINT AS bytes FROM customer"""


@query(
    f"""WITH f AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS format, CASE WHEN starts_with(path, '/root/p/') THEN substr(path, 9) ELSE path END AS stored FROM ({_FILES})),
    r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY path) AS k FROM f WHERE format IN ('mp4', 'webm') AND filename NOT IN ('t13.webm', 't18.webm'))
    SELECT 'recording' AS kind, printf('rec_%02d', row_number() OVER (ORDER BY path) + 2) AS id, filename, stored, format, bytes FROM r WHERE k = 1
    UNION ALL SELECT 'transcript', printf('tr_%02d', row_number() OVER (ORDER BY path) + 1), filename, stored, format, bytes FROM f WHERE format IN ('md', 'vtt')"""
)
def transcripts(spark, sf):
    """Many files registered at once: recordings and transcripts with their ids."""
    files = _read(spark, sf, "customer").select(F.expr(_FILES[len("SELECT ") : _FILES.index(" AS path")].replace("printf(", "format_string(")).alias("path"), F.col("c_custkey").cast("long").alias("bytes"))
    known = spark.createDataFrame([("t13.webm",), ("t18.webm",)], "filename string")
    return registry.additions(files, known, 2, 1, F.lit("/root/p"))


@query("SELECT l_returnflag, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS names FROM lineitem GROUP BY 1")
def joined_names(spark, sf):
    return registry.joined_names(_read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT (h * 8) // 180 * 8 + s // 32 AS bin, count(*) AS n FROM (SELECT floor(value % 180)::INT AS h, (event_id % 256)::INT AS s FROM events WHERE value >= 0) GROUP BY ALL")
def hist2d(spark, sf):
    """Hue and saturation bins, 8 by 8 over [0,180) and [0,256), as the embedder has them."""
    rows = _read(spark, sf, "events").where("value >= 0")
    return rows.groupBy(images.color_bin_column(F.floor(F.col("value") % 180).cast("int"), (F.col("event_id") % 256).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN border > 0.85 AND drop > 8 THEN 'modal' WHEN top > 0.9 AND middle < 0.6 AND abs(drop) < 8 THEN 'tab' ELSE 'navigation' END AS kind FROM (
      SELECT event_id, (event_id * 7 % 100) / 100.0 AS border, event_id % 31 - 10 AS drop, (event_id * 13 % 100) / 100.0 AS top, (event_id * 3 % 100) / 100.0 AS middle FROM events)"""
)
def boundary_kind(spark, sf):
    e = F.col("event_id")
    border = F.when(e % 11 != 0, (e * 7 % 100) / 100.0)
    return _read(spark, sf, "events").select("event_id", S.boundary_kind(border, (e % 31 - 10).cast("double"), (e * 13 % 100) / 100.0, (e * 3 % 100) / 100.0)["kind"].alias("kind"))


@query("WITH" + _STATE_RUNS + ", nx AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY recording_id ORDER BY seg_no) AS to_state FROM er) SELECT from_state, to_state, count(*) AS n FROM nx WHERE to_state <> from_state GROUP BY ALL")
def event_graph(spark, sf):
    """Runs of event types as segments, their types as states."""
    runs = _state_runs(spark, sf).select("recording_id", "seg_no", F.col("event_type").alias("state_id"), F.col("start_idx").cast("double").alias("start_time"), F.col("start_idx").alias("rep_idx"), F.col("seg_no").alias("flat_no"))
    return S.workflow_graph(S.state_changes(runs))


def _metrics(changes):
    """Metrics of borders by the number of the segment after them; of every eleventh a frame can't be read."""
    k = F.col("flat_no")
    value = lambda v: F.when(k % 11 != 0, v.cast("double"))
    return changes.select("flat_no", value((k * 7 % 100) / 100).alias("border"), value(k % 31 - 10).alias("drop"), value((k * 13 % 100) / 100).alias("top"), value((k * 3 % 100) / 100).alias("middle"))


_KINDS = """, kd AS (SELECT *, CASE WHEN to_no % 11 = 0 THEN 'unknown' WHEN (to_no * 7 % 100) / 100.0 > 0.85 AND to_no % 31 - 10 > 8 THEN 'modal'
  WHEN (to_no * 13 % 100) / 100.0 > 0.9 AND (to_no * 3 % 100) / 100.0 < 0.6 AND abs(to_no % 31 - 10) < 8 THEN 'tab' ELSE 'navigation' END AS kind FROM nx WHERE to_state <> state_id)"""


@query(
    _ALL + _KINDS
    + """ SELECT printf('trans_%04d', row_number() OVER (ORDER BY recording_id, to_no)) AS id, state_id AS from_state, to_state, rep_idx AS from_idx, to_rep AS to_idx, kind,
      CASE kind WHEN 'unknown' THEN 0.3 WHEN 'modal' THEN 0.6 WHEN 'tab' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM kd"""
)
def transition_kinds(spark, sf):
    """Transitions with the metrics of their borders, and the representative frames that those are taken of."""
    changes = S.state_changes(_labelled(spark, sf))
    numbered = S.transitions(changes, _metrics(changes), keep_number=True).join(changes.select("flat_no", "from_idx", "to_idx"), "flat_no")
    return numbered.select("id", "from_state", "to_state", "from_idx", "to_idx", "kind", "confidence")


@query(_ALL + _KINDS + " SELECT kind, count(*) AS n FROM kd GROUP BY kind")
def kind_counts(spark, sf):
    changes = S.state_changes(_labelled(spark, sf))
    return views.kind_counts(S.transitions(changes, _metrics(changes)))


def _vector_shifts(frames):
    """Shifts between the vectors' frames that scroll for some frames at a time, up and down."""
    k = F.col("idx")
    return frames.select("recording_id", "idx", (k * 3 % 11 - 5).cast("double").alias("dx"), (F.floor(k / 5) * 29 % 61 - 30).cast("double").alias("dy"), F.when(k % 13 == 0, 0.4).otherwise(0.9).alias("response"))


def _scrolled(spark, sf):
    frames = _frames(spark, sf)
    return S.labelled_segments(G.segment_recordings(frames, _vector_shifts(frames), CONFIG), CONFIG.merge_distance)


_SCROLL = """
vs AS (
  SELECT recording_id, idx, CASE WHEN CASE WHEN idx % 13 = 0 THEN 0.4 ELSE 0.9 END >= 0.5 AND abs(idx // 5 * 29 % 61 - 30) >= 20 AND abs(idx * 3 % 11 - 5) <= 4 AND dist >= 0.05
    THEN CASE WHEN idx // 5 * 29 % 61 - 30 >= 0 THEN 1 ELSE -1 END ELSE 0 END AS s FROM pd),
vr AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) AS r FROM (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY recording_id ORDER BY idx) IS DISTINCT FROM s THEN 1 ELSE 0 END AS c FROM vs)),
runs AS (SELECT recording_id, min(idx) AS a, max(idx) + 1 AS b FROM vr WHERE s <> 0 GROUP BY recording_id, r HAVING count(*) >= 2),
cut AS (SELECT p.recording_id, p.idx, p.dist > 1.0 AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.recording_id = p.recording_id AND p.idx >= r.a AND p.idx < r.b) AS is_cut FROM pd p),
isl AS (
  SELECT fr.*, coalesce(sum(CASE WHEN is_cut THEN 1 ELSE 0 END) OVER (PARTITION BY fr.recording_id ORDER BY fr.idx), 0)::INT AS seg_no
  FROM fr LEFT JOIN cut ON cut.recording_id = fr.recording_id AND cut.idx = fr.idx - 1),"""


def _with_scroll() -> str:
    """The folds over segments with scroll runs, in which scrolls and screens make states of their own."""
    frames = _FRAMES[: _FRAMES.index("\nisl AS")] + _SCROLL + _FRAMES[_FRAMES.index("\nmean AS") :]
    folds = _FOLDS[: _FOLDS.index("\nlab AS")]
    for old, new in (
        ("FROM sg),\ncl AS", "FROM (SELECT g.*, r.a, r.b, r.a IS NOT NULL AS is_scroll FROM sg g LEFT JOIN best r ON r.recording_id = g.recording_id AND r.seg_no = g.seg_no)),\ncl AS"),
        ("fl AS (", "best AS (SELECT * FROM (SELECT g.recording_id, g.seg_no, r.a, r.b, row_number() OVER (PARTITION BY g.recording_id, g.seg_no ORDER BY r.b - r.a DESC, r.a) AS k FROM sg g JOIN runs r ON r.recording_id = g.recording_id AND r.a >= g.start_idx AND r.b <= g.end_idx) WHERE k = 1),\nfl AS ("),
        ("SELECT 0 AS flat_no, [centroid] AS cs, 0 AS label FROM fl", "SELECT 0 AS flat_no, [centroid] AS cs, [is_scroll] AS ks, 0 AS label FROM fl"),
        ("ELSE c END) END, label", "ELSE c END) END, CASE WHEN label = len(cs) THEN list_append(ks, is_scroll) ELSE ks END, label"),
        ("SELECT f.flat_no, f.centroid, cs, CASE", "SELECT f.flat_no, f.centroid, f.is_scroll, cs, ks, CASE"),
        ("SELECT f.flat_no, f.centroid, c.cs, list_transform(c.cs, lambda x: 1 - list_inner_product(x, f.centroid)) AS ds", "SELECT f.flat_no, f.centroid, f.is_scroll, c.cs, c.ks, list_transform(c.cs, lambda x, i: CASE WHEN c.ks[i] = f.is_scroll THEN 1 - list_inner_product(x, f.centroid) ELSE 9 END) AS ds"),
    ):
        assert old in folds, old
        folds = folds.replace(old, new)
    return "WITH RECURSIVE" + frames + folds


@query(_with_scroll() + " SELECT fl.recording_id, seg_no, start_idx, end_idx, rep_idx, is_scroll, a AS scroll_start_idx, b AS scroll_end_idx, printf('state_%04d', label + 1) AS state_id FROM fl JOIN cl USING (flat_no)")
def scroll_states(spark, sf):
    """The flagship with scroll runs: they end no segment, and scrolls and screens never share a state."""
    return _scrolled(spark, sf).select("recording_id", "seg_no", "start_idx", "end_idx", "rep_idx", "is_scroll", "scroll_start_idx", "scroll_end_idx", "state_id")
