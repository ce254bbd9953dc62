import numpy as np
import pytest

from tideframe.config import Config
from tideframe.operators import pairs, segments, states

FRAMES = "recording_id string, idx int, ts double, vec array<double>"


def frames_of(spark, *vectors, rec="rec_01"):
    return spark.createDataFrame([(rec, k, float(k), [float(x) for x in v]) for k, v in enumerate(vectors)], FRAMES)


A, B, X = (1, 0, 0), (0, 1, 0), (0, 0, 1)


def ranges(df):
    return [(r["start_idx"], r["end_idx"]) for r in df.orderBy("recording_id", "seg_no").collect()]


def test_transient_is_dropped_and_neighbours_merge(spark):
    assert ranges(segments.segment_recordings(frames_of(spark, A, A, A, X, A, A, A), None, Config())) == [(0, 6)]


def test_distinct_screens(spark):
    assert ranges(segments.segment_recordings(frames_of(spark, A, A, B, B), None, Config())) == [(0, 1), (2, 3)]


def test_blip_at_an_end_stays(spark):
    assert ranges(segments.segment_recordings(frames_of(spark, X, A, A, A, X), None, Config())) == [(0, 0), (1, 3), (4, 4)]


def test_one_frame_and_none(spark):
    assert ranges(segments.segment_recordings(frames_of(spark, A), None, Config())) == [(0, 0)]
    assert ranges(segments.segment_recordings(frames_of(spark), None, Config())) == []


def test_blip_between_merge_and_cut_leaves_its_frame_out(spark):
    v = (0.84, np.sqrt(1 - 0.84**2), 0)  # distance .16 from A
    assert ranges(segments.segment_recordings(frames_of(spark, A, A, X, v, v), None, Config())) == [(0, 1), (3, 4)]


def shifts(spark, dys, response=0.9):
    return spark.createDataFrame([("rec_01", k, 0.0, float(dy), response) for k, dy in enumerate(dys)], "recording_id string, idx int, dx double, dy double, response double")


@pytest.mark.parametrize(
    "dys, want",
    [([120, 120, 120, 0, -120], [(0, 3, 1)]), ([9, 9, -9, -9], [(0, 2, 1), (2, 4, -1)]), ([9], []), ([], []), ([9, 0, 9, 0], [])],
)
def test_scroll_runs(spark, dys, want):
    got = pairs.scroll_runs(shifts(spark, dys), Config()).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["direction"]) for r in got] == want


def test_distance_at_a_threshold(spark):
    rows = spark.createDataFrame([("r", 0, 0.25, 0.0, 9.0, 0.9), ("r", 1, 0.25, 0.0, 9.0, 0.9)], "recording_id string, idx int, dist double, dx double, dy double, response double")
    cfg = Config(cut_distance=0.25, scroll_min_embedding_change=0.25)
    runs = pairs.scroll_runs(rows, cfg)
    assert runs.count() == 1
    assert {r["kind"] for r in pairs.classify_pairs(rows, runs.limit(0), cfg).collect()} == {"static"}


def test_equal_runs_keep_the_earlier(spark):
    seg = spark.createDataFrame([("r", 0, 0, 9)], "recording_id string, seg_no int, start_idx int, end_idx int")
    runs = spark.createDataFrame([("r", 5, 7, 1), ("r", 1, 3, 1), ("r", 8, 12, 1)], "recording_id string, start_idx int, end_idx int, direction int")
    r = segments.annotate_scroll(seg, runs).first()
    assert (r["is_scroll"], r["scroll_start_idx"], r["scroll_end_idx"]) == (True, 1, 3)


def cluster(spark, rows, merge):
    df = spark.createDataFrame([(k, [float(x) for x in v], s) for k, (v, s) in enumerate(rows)], "flat_no int, centroid array<double>, is_scroll boolean")
    return [r["label"] for r in states.greedy_clusters(df, merge).orderBy("flat_no").collect()]


def test_clusters(spark):
    near = (0.99, 0.01, 0) / np.linalg.norm((0.99, 0.01, 0))
    assert cluster(spark, [(A, False), (B, False), (near, False)], 0.1) == [0, 1, 0]
    assert cluster(spark, [((1, 0), False), ((1, 0), True)], 0.5) == [0, 1]
    assert cluster(spark, [(A, False), (B, False), ((np.sqrt(0.5), np.sqrt(0.5), 0), False)], 0.5) == [0, 1, 0]


def test_canonical_first_of_equals_and_no_self_transition(spark):
    rows = [(0, "r", 0, 0, 1, 0.0, 1.0, 0, 0.5), (1, "r", 1, 2, 3, 2.0, 3.0, 2, 0.5), (2, "r", 2, 4, 5, 4.0, 5.0, 4, 0.4)]
    df = spark.createDataFrame(rows, "flat_no int, recording_id string, seg_no int, start_idx int, end_idx int, start_time double, end_time double, rep_idx int, confidence double")
    df = df.selectExpr("*", "CASE WHEN flat_no < 2 THEN 0 ELSE 1 END AS label", "CASE WHEN flat_no < 2 THEN 'state_0001' ELSE 'state_0002' END AS state_id", "false AS is_scroll", "cast(null as int) AS scroll_start_idx", "cast(null as int) AS scroll_end_idx")
    assert [(r["from_idx"], r["to_idx"]) for r in states.state_changes(df).collect()] == [(2, 4)]
    assert [r["canonical"]["flat_no"] for r in states.canonical_members(df).orderBy("label").collect()] == [0, 2]
    t = states.transitions(states.state_changes(df)).collect()
    assert [(r["id"], r["from_state"], r["to_state"], r["at"], r["kind"]) for r in t] == [("trans_0001", "state_0001", "state_0002", 4.0, "unknown")]


def test_many_clusters_grow(spark):
    rng = np.random.default_rng(1)
    vs = rng.normal(size=(300, 64))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    assert cluster(spark, [(v, False) for v in vs] + [(vs[7], False)], 0.1) == [*range(300), 7]


def folded(vectors, cuts, config, drop=True, merge=True):
    """The folds as they are defined, over whole vectors."""
    unit = lambda m: m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-8 else m
    centroid = lambda r: unit(vectors[r[0] : r[1] + 1].mean(axis=0))
    first = [0, *[c + 1 for c in cuts]]
    ranges = list(zip(first, [*cuts, len(vectors) - 1], strict=True))
    if drop and len(ranges) > 2:
        kept = ranges[:1]
        for now, after in zip(ranges[1:-1], ranges[2:], strict=True):
            if not (now[1] + 1 - now[0] < config.min_state_seconds and 1 - centroid(kept[-1]) @ centroid(after) <= config.cut_distance):
                kept.append(now)
        ranges = [*kept, ranges[-1]]
    out = ranges[:1]
    for r in ranges[1:]:
        if merge and 1 - centroid(out[-1]) @ centroid(r) <= config.merge_distance:
            out[-1] = out[-1][0], r[1]
        else:
            out.append(r)
    return out, [centroid(r) for r in out]


def walks(seed=3, recordings=12, most=80):
    rng = np.random.default_rng(seed)
    for rec in range(recordings):
        v, n, out = None, int(rng.integers(1, most)), []
        for _ in range(n):
            if v is None or rng.random() < 0.4:
                v = np.abs(rng.normal(size=5))
            w = v + rng.normal(size=5) * 0.1
            out.append(w / np.linalg.norm(w))
        yield f"rec_{rec:02d}", np.stack(out)


@pytest.mark.parametrize("drop, merge", [(True, True), (True, False), (False, True)])
def test_folds_over_island_sums(spark, drop, merge, monkeypatch):
    monkeypatch.setattr(segments, "_OPEN", 3)  # sums of one island leave a task in several rows
    config = Config(cut_distance=0.4, merge_distance=0.25, min_state_seconds=2.5)
    rows, want, near = [], [], {}
    for rec, vs in walks():
        cuts = [k for k in range(len(vs) - 1) if 1 - vs[k] @ vs[k + 1] > config.cut_distance]
        seg = np.cumsum(np.isin(np.arange(len(vs)), np.array(cuts, int) + 1))
        rows += [(rec, k, float(k), v.tolist(), int(s)) for k, (v, s) in enumerate(zip(vs, seg, strict=True))]
        for k, (r, c) in enumerate(zip(*folded(vs, cuts, config, drop, merge), strict=True)):
            d = 1 - vs[r[0] : r[1] + 1] @ c
            want.append((rec, k, *r, round(1 - d.mean(), 6), *np.round(c, 6)))
            near[rec, k] = {r[0] + int(j) for j in np.flatnonzero(d < d.min() + 1e-9)}  # both frames of two are equally near
    islands = spark.createDataFrame(rows, FRAMES + ", seg_no int").repartition(7)
    made = segments.fold_segments(islands, config, drop, merge).collect()
    got = [(r["recording_id"], r["seg_no"], r["start_idx"], r["end_idx"], round(r["confidence"], 6), *np.round(r["centroid"], 6)) for r in made]
    assert sorted(got) == sorted(want) and all(r["rep_idx"] in near[r["recording_id"], r["seg_no"]] for r in made)
    found = segments.segment_ranges(islands, config, drop, merge)
    assert sorted((r["recording_id"], r["seg_no"], r["start_idx"], r["end_idx"], float(r["start_idx"]), float(r["end_idx"])) for r in found.collect()) == sorted((w[0], w[1], w[2], w[3], float(w[2]), float(w[3])) for w in want)


def test_vector_sums_make_no_row_for_a_dimension(spark):
    islands = spark.createDataFrame([("r", k, float(k), [1.0, float(k)], k // 10) for k in range(40)], FRAMES + ", seg_no int").coalesce(2)
    sums = segments.vector_sums(islands)
    assert sums.count() <= 8 and "Generate" not in sums._jdf.queryExecution().toString()
    got = {r["seg_no"]: r["centroid"] for r in segments.segment_centroids(islands).collect()}
    for k, c in got.items():
        m = np.array([1.0, np.mean(range(10 * k, 10 * k + 10))])
        assert np.allclose(c, m / np.linalg.norm(m))


def test_runs_meet_segments_in_one_sweep(spark):
    rng = np.random.default_rng(2)
    segs, runs = [], []
    for rec in ("a", "b"):
        at = 0
        for k in range(40):
            end = at + int(rng.integers(0, 9))
            segs.append((rec, k, at, end))
            at = end + 1 + int(rng.integers(0, 3))  # frames of dropped islands lie between
        starts = np.sort(rng.choice(at, 60, replace=False))
        runs += [(rec, int(s), int(s + rng.integers(1, 6)), 1) for s in starts]
    seg, run = spark.createDataFrame(segs, "recording_id string, seg_no int, start_idx int, end_idx int"), spark.createDataFrame(runs, "recording_id string, start_idx int, end_idx int, direction int")
    for r in segments.annotate_scroll(seg, run).collect():
        inside = [(s, e) for rec, s, e, _ in runs if rec == r["recording_id"] and s >= r["start_idx"] and e <= r["end_idx"]]
        best = max(inside, key=lambda x: (x[1] - x[0], -x[0]), default=(None, None))
        assert (r["scroll_start_idx"], r["scroll_end_idx"], r["is_scroll"]) == (*best, bool(inside))
    assert segments.annotate_scroll(seg, run.limit(0)).where("is_scroll").count() == 0


def test_ranges_of_a_long_recording(spark, monkeypatch):
    """Pairs, runs, cuts and segments are the same however many ranges a recording has."""
    rng = np.random.default_rng(8)
    config = Config(cut_distance=0.4, merge_distance=0.25, min_state_seconds=2.5, scroll_min_embedding_change=0.01)
    rows, moved = [], []
    for rec, vs in walks(9, 4, 90):
        rows += [(rec, k, float(k), v.tolist()) for k, v in enumerate(vs)]
        moved += [(rec, k, 0.0, float(rng.choice([0, 30, 30, 30, -30])), 0.9) for k in range(len(vs) - 1)]
    frames, shift = spark.createDataFrame(rows, FRAMES).repartition(3), spark.createDataFrame(moved, "recording_id string, idx int, dx double, dy double, response double")
    seen = []
    for size in (1 << 14, 1, 2, 7, 30):
        monkeypatch.setattr(pairs, "RANGE", size)
        dist = pairs.frame_pairs(frames)
        runs = pairs.scroll_runs(dist.join(shift, ["recording_id", "idx"]), config)
        islands = pairs.cut_islands(frames, pairs.classify_pairs(dist, runs, config))
        found = segments.segment_recordings(frames, shift, config)
        told = lambda df, *cs: sorted(tuple(r[c] for c in cs) for r in df.collect())
        seen.append((
            [(*x[:2], round(x[2], 9)) for x in told(dist, "recording_id", "idx", "dist")], told(runs, "recording_id", "start_idx", "end_idx", "direction"), told(islands, "recording_id", "idx", "seg_no"),
            told(found, "recording_id", "seg_no", "start_idx", "end_idx", "rep_idx", "is_scroll"),
        ))
    assert all(x == seen[0] for x in seen[1:]) and len(seen[0][0]) == len(moved) and len(seen[0][1]) > 10


def test_a_missing_pair_ends_a_run(spark):
    rows = [("r", k, 0.0, 30.0, 0.9) for k in (0, 1, 3, 4)]
    got = pairs.scroll_runs(spark.createDataFrame(rows, "recording_id string, idx int, dx double, dy double, response double"), Config())
    assert sorted((r["start_idx"], r["end_idx"]) for r in got.collect()) == [(0, 2), (3, 5)]
