import random

import numpy as np
import pytest

from tideframe.config import Config
from tideframe.operators import segments, states
from tideframe.streaming import segments as final
from tideframe.streaming.incremental import rebuild_on_arrival

SCHEMA = "recording_id string, idx int, ts double, vec array<double>"
A, B = [1.0, 0.0], [0.0, 1.0]


def test_a_stream_with_shifts_finds_scroll_runs(spark, tmp_path):

    vs = [[float(np.cos(k * 0.4)), float(np.sin(k * 0.4))] for k in range(6)]
    rows = [("rec_01", k, float(k), v, 0.0, 90.0 if k < 5 else None, 0.9) for k, v in enumerate(vs)]
    schema = SCHEMA + ", dx double, dy double, response double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    seen = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep = lambda df, n: seen.append([(r["start_idx"], r["end_idx"], r["is_scroll"]) for r in df.collect()])
    rebuild_on_arrival(stream, f"{tmp_path}/table", Config(cut_distance=0.01), keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(0, 5, True)]]


def test_stream_ends_where_the_batch_build_does(spark, tmp_path):
    rows = [("rec_01", k, float(k), A if k < 3 else B) for k in range(6)] + [("rec_02", k, float(k), A) for k in range(3)]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep = lambda df, n: seen.append(sorted(map(tuple, df.select("recording_id", "start_idx", "end_idx", "state_id").collect())))
    rebuild_on_arrival(stream, f"{tmp_path}/table", Config(), keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    whole = states.labelled_segments(segments.segment_recordings(spark.createDataFrame(rows, SCHEMA), None, Config()), Config().merge_distance)
    assert len(seen) == 2 and seen[-1] == sorted(map(tuple, whole.select("recording_id", "start_idx", "end_idx", "state_id").collect()))


SHIFTED = SCHEMA + ", dx double, dy double, response double, last boolean"
CONFIG = Config(cut_distance=0.5, merge_distance=0.3, min_state_seconds=2.5, scroll_min_embedding_change=0.01)


def recordings(ends=True):
    rng = np.random.default_rng(4)
    for rec in range(6):
        v, n = None, int(rng.integers(1, 50))
        for k in range(n):
            if v is None or rng.random() < 0.35:
                v = np.abs(rng.normal(size=6))
            w = v + rng.normal(size=6) * 0.1
            yield f"rec_{rec}", k, float(k), (w / np.linalg.norm(w)).tolist(), 0.0, float(rng.choice([0, 40, 40, -40])), 0.9, ends and k == n - 1


def told(df):
    return sorted((r["recording_id"], r["seg_no"], r["start_idx"], r["end_idx"], r["rep_idx"], round(r["confidence"], 9), r["is_scroll"], r["scroll_start_idx"], r["scroll_end_idx"]) for r in df.collect())


def built(spark, rows):
    df = spark.createDataFrame(rows, SHIFTED)
    return told(segments.segment_recordings(df.select("recording_id", "idx", "ts", "vec"), df.select("recording_id", "idx", "dx", "dy", "response"), CONFIG))


def test_recording_fold_tells_what_the_build_finds(spark):
    rows, out = list(recordings()), []
    for rec in sorted({r[0] for r in rows}):
        fold, frames, early = final.RecordingFold(rec, CONFIG), [r for r in rows if r[0] == rec], 0
        found = []
        for _, idx, ts, vec, dx, dy, response, _ in frames:
            found += fold.add(idx, ts, np.array(vec), dx, dy, response)
        early = len(found)
        found += fold.close()
        assert early < len(found)
        out += [(rec, k, s.start_idx, s.end_idx, fold.longest_run(s)) for k, s in enumerate(found)]
    assert out == [(w[0], w[1], w[2], w[3], (w[7], w[8]) if w[6] else None) for w in built(spark, rows)]


@pytest.fixture(scope="module")
def keyed(spark):
    """The state store that keeps keyed state."""
    for k, v in final.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in final.STORE:
        spark.conf.unset(k)


def advance(spark, tmp_path, **options):
    """One run of the query over the files that are new, each a batch; every run is a restart from the checkpoint."""
    stream = spark.readStream.schema(SHIFTED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = final.final_segments(stream, CONFIG, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    return out.outputMode("append")


def test_each_final_segment_is_told_once_across_restarts(keyed, tmp_path):
    rows = list(recordings())
    random.seed(1)
    mixed = sorted(rows, key=lambda r: r[1] + random.random() * 12)  # frames out of order, within and across batches
    cuts = [0, 40, 41, 90, len(mixed)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        keyed.createDataFrame(mixed[a:b] + mixed[max(a - 3, 0) : a], SHIFTED).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k != 1:  # two files are two batches of one run
            advance(keyed, tmp_path).trigger(availableNow=True).start().awaitTermination()
    assert told(keyed.read.parquet(f"{tmp_path}/out")) == built(keyed, rows)


def test_a_recording_that_falls_silent_is_closed(keyed, tmp_path):
    import time

    rows = [r for r in recordings(ends=False) if r[0] in ("rec_0", "rec_1")]
    keyed.createDataFrame(rows, SHIFTED).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    query = advance(keyed, tmp_path, idle_ms=500).trigger(processingTime="1 second").start()
    want, until = built(keyed, rows), time.time() + 90
    try:
        while time.time() < until:
            time.sleep(1)
            try:
                if len(told(keyed.read.parquet(f"{tmp_path}/out"))) >= len(want):
                    break
            except Exception:  # nothing has been written yet
                continue
    finally:
        query.stop()
    assert told(keyed.read.parquet(f"{tmp_path}/out")) == want
