"""Segments: aggregates over frame ranges and the ordered folds that drop blips and merge neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched, count, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import clamp01, cosine_distance, l2_normalized
from .pairs import classify_pairs, cut_islands, frame_pairs, scroll_runs


_SUMS = "recording_id string, seg_no int, n bigint, start_idx int, end_idx int, start_time double, end_time double, total array<double>"
#: Islands of which a task keeps sums at a time.
_OPEN = 256


class Island(NamedTuple):
    """Frames from ``start_idx`` to ``end_idx`` of a recording, and the sum of their vectors."""

    recording_id: str
    seg_no: int
    n: int
    start_idx: int
    end_idx: int
    start_time: float
    end_time: float
    total: np.ndarray

    def with_(self, other: Island) -> Island:
        """Both as one, named as the first."""
        idx, ts = (self.start_idx, self.end_idx, other.start_idx, other.end_idx), (self.start_time, self.end_time, other.start_time, other.end_time)
        return Island(self.recording_id, self.seg_no, self.n + other.n, min(idx), max(idx), min(ts), max(ts), self.total + other.total)

    def centroid(self) -> np.ndarray:
        m = self.total / self.n
        norm = np.linalg.norm(m)
        return m / norm if norm > 1e-8 else m


def _vectors(column: pa.Array) -> np.ndarray:
    """A batch's vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _rows(islands: Iterable[Island]) -> pa.RecordBatch:
    columns = list(zip(*islands, strict=True))
    totals = np.stack(columns[-1])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(totals) + 1) * totals.shape[1], pa.int32()), pa.array(totals.ravel()))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
    return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns[:-1], kinds, strict=True)), lists], list(Island._fields))


def vector_sums(islands: DataFrame) -> DataFrame:
    """Partial sums of vectors: a row for each island (recording_id, seg_no) and task, or some if its frames lie apart.

    islands: recording_id, seg_no, idx, ts, vec, all vectors of one length. Frames are added up in Arrow batches where they
    are, so no frame is moved and none becomes a row for each of its dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Island] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rec, seg = batch["recording_id"].to_numpy(zero_copy_only=False), batch["seg_no"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero((rec[1:] != rec[:-1]) | (seg[1:] != seg[:-1])) + 1])
            idx, ts = batch["idx"].to_numpy(), batch["ts"].to_numpy()
            each = zip(
                rec[first], seg[first].tolist(), np.diff(first, append=len(rec)).tolist(), np.minimum.reduceat(idx, first).tolist(), np.maximum.reduceat(idx, first).tolist(),
                np.minimum.reduceat(ts, first).tolist(), np.maximum.reduceat(ts, first).tolist(), np.add.reduceat(_vectors(batch["vec"]), first, axis=0), strict=True,
            )
            for row in map(Island._make, each):
                old = known.pop(row[:2], None)
                known[row[:2]] = row if old is None else old.with_(row)
            if len(known) > _OPEN:
                yield _rows(known.values())
                known = {}
        if known:
            yield _rows(known.values())

    return islands.select("recording_id", "seg_no", "idx", "ts", "vec").mapInArrow(run, _SUMS)


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[Island]:
    """Whole islands out of sorted partial sums, of which one is kept at a time."""
    last = None
    for batch in batches:
        totals = _vectors(batch["total"])
        for *row, k in zip(*(batch[c].to_pylist() for c in Island._fields[:-1]), range(batch.num_rows), strict=True):
            now = Island(*row, totals[k])
            if last is not None and last[:2] == now[:2]:
                last = last.with_(now)
                continue
            if last is not None:
                yield last
            last = now
    if last is not None:
        yield last


def segment_centroids(islands: DataFrame) -> DataFrame:
    """recording_id, seg_no, centroid: the normalised mean vector of each island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(_in_turn(batches), _OPEN):
            yield pa.record_batch([pa.array([x.recording_id for x in some]), pa.array([x.seg_no for x in some], pa.int32()), pa.array([x.centroid() for x in some], pa.list_(pa.float64()))], ["recording_id", "seg_no", "centroid"])

    sums = vector_sums(islands).repartition("recording_id", "seg_no").sortWithinPartitions("recording_id", "seg_no", "start_idx")
    return sums.mapInArrow(run, "recording_id string, seg_no int, centroid array<double>")


def segment_stats(islands: DataFrame) -> DataFrame:
    """Each island's bounds, representative (nearest to the centroid, first of equals) and confidence."""
    rows = islands.join(segment_centroids(islands), ["recording_id", "seg_no"]).withColumn("_d", cosine_distance(F.col("centroid"), F.col("vec")))
    return rows.groupBy("recording_id", "seg_no").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.min_by("idx", F.struct("_d", "idx")).alias("rep_idx"), F.first("centroid").alias("centroid"), clamp01(1 - F.avg("_d")).alias("confidence"),
    )


def segment_durations(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Time from a segment's start to the frame after its end; the last one of a recording ends with its last step, at least."""
    w = Window.partitionBy("recording_id").orderBy("idx")
    ends = frames.select("recording_id", F.col("idx").alias("end_idx"), F.lead("ts").over(w).alias("_after"), (F.col("ts") - F.lag("ts").over(w)).alias("_step"))
    rows = segments.join(ends, ["recording_id", "end_idx"])
    lasts = F.greatest(F.col("end_time") - F.col("start_time"), F.coalesce("_step", F.lit(0.0)))
    return rows.withColumn("duration", F.coalesce(F.col("_after") - F.col("start_time"), lasts)).drop("_after", "_step")


class SegmentFold:
    """The folds over one recording's islands in order: segments come out as soon as nothing that follows can change them.

    An inner island that is short is dropped while the last kept one and the next one look alike. A kept one that is near to
    the open segment's centroid joins it, with all frames between them; another closes it. So the island whose successor isn't
    known waits, and the segment that may still grow; beside them no more than two sums are kept.
    """

    def __init__(self, config: Config, drop: bool = True, merge: bool = True):
        self._config, self._drop, self._merge = config, drop, merge
        self._kept = self._waits = self._open = self._between = None
        self._inner = False  # whether an island came before the one that waits
        self._last = -1

    def add(self, island: Island) -> list[tuple[Island, int, int]]:
        """Segments that this island makes final: as one island, and the numbers of their first and last island."""
        if self._waits is None:
            self._waits = island
            return []
        now, self._waits = self._waits, island
        if self._inner and self._drop and island.start_time - now.start_time < self._config.min_state_seconds and 1.0 - self._kept.centroid() @ island.centroid() <= self._config.cut_distance:
            self._between = now if self._between is None else self._between.with_(now)
            return []
        self._inner = True
        return self._keep(now)

    def close(self) -> list[tuple[Island, int, int]]:
        """What is left when a recording ends: its last island is kept."""
        if self._waits is None:
            return []
        out = self._keep(self._waits)
        return [*out, (self._open, self._open.seg_no, self._last)]

    def _keep(self, island: Island) -> list[tuple[Island, int, int]]:
        self._kept, between, self._between, out = island, self._between, None, []
        if self._open is not None and self._merge and 1.0 - self._open.centroid() @ island.centroid() <= self._config.merge_distance:
            self._open = (self._open if between is None else self._open.with_(between)).with_(island)
        else:
            if self._open is not None:
                out = [(self._open, self._open.seg_no, self._last)]
            self._open = island
        self._last = island.seg_no
        return out


def segment_ranges(islands: DataFrame, config: Config, drop: bool = True, merge: bool = True) -> DataFrame:
    """recording_id, seg_no, start_idx, end_idx, start_time, end_time, centroid and the islands that each segment is made of.

    islands: recording_id, idx (from 0 without gaps), ts, vec, seg_no. The folds see one sum an island, in order, and keep a
    few of them, so a recording may be of any length. Null rows of vec aren't allowed. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(found(batches), _OPEN):
            head = pa.array([s.recording_id for _, (s, _, _) in some]), pa.array([k for k, _ in some], pa.int32())
            at = [pa.array([getattr(s, c) for _, (s, _, _) in some], t) for c, t in (("start_idx", pa.int32()), ("end_idx", pa.int32()), ("start_time", pa.float64()), ("end_time", pa.float64()))]
            tail = pa.array([s.centroid() for _, (s, _, _) in some], pa.list_(pa.float64())), *(pa.array([x[k] for _, x in some], pa.int32()) for k in (1, 2))
            yield pa.record_batch([*head, *at, *tail], ["recording_id", "seg_no", "start_idx", "end_idx", "start_time", "end_time", "centroid", "first", "last"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[Island, int, int]]]:
        for _, each in groupby(_in_turn(batches), key=lambda x: x.recording_id):
            fold = SegmentFold(config, drop, merge)
            number = count()
            for island in each:
                for final in fold.add(island):
                    yield next(number), final
            for final in fold.close():
                yield next(number), final

    sums = vector_sums(islands).repartition("recording_id").sortWithinPartitions("recording_id", "seg_no", "start_idx")
    return sums.mapInArrow(run, "recording_id string, seg_no int, start_idx int, end_idx int, start_time double, end_time double, centroid array<double>, first int, last int")


def fold_segments(islands: DataFrame, config: Config, drop: bool = True, merge: bool = True) -> DataFrame:
    """Segments of each recording after the folds, with their representative and confidence; arguments as above.

    Frames meet their segment by the island that they lie in, so a long recording is spread over tasks here.
    """
    found = segment_ranges(islands, config, drop, merge)
    of = found.select("recording_id", "seg_no", "start_idx", "end_idx", "start_time", "end_time", "centroid", F.explode(F.sequence("first", "last")).alias("island"))
    rows = islands.select("recording_id", F.col("seg_no").alias("island"), "idx", "vec").join(of, ["recording_id", "island"]).withColumn("_d", cosine_distance(F.col("centroid"), F.col("vec")))
    return rows.groupBy("recording_id", "seg_no").agg(
        *[F.first(c).alias(c) for c in ("start_idx", "end_idx", "start_time", "end_time")], F.min_by("idx", F.struct("_d", "idx")).alias("rep_idx"),
        F.first("centroid").alias("centroid"), clamp01(1 - F.avg("_d")).alias("confidence"),
    )


def annotate_scroll(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """``segments`` with is_scroll, scroll_start_idx and scroll_end_idx: the longest run inside, the earliest of equals.

    A recording's segments don't overlap, so a run can only lie in the last one that starts before it: one sweep over both, in
    order of their starts, finds it.
    """
    own = F.struct("seg_no", "end_idx").alias("_seg")
    starts = segments.select("recording_id", F.col("start_idx").alias("_at"), F.lit(0).alias("_kind"), own, F.lit(None).cast("int").alias("_end"))
    both = starts.unionByName(runs.select("recording_id", F.col("start_idx").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_seg"].dataType).alias("_seg"), F.col("end_idx").alias("_end")))
    sweep = Window.partitionBy("recording_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(sweep)).where("_kind = 1 AND _end <= _seg.end_idx")
    best = inside.groupBy("recording_id", F.col("_seg.seg_no").alias("seg_no")).agg(F.max_by(F.struct(F.col("_at").alias("run_start"), F.col("_end").alias("run_end")), F.struct(F.col("_end") - F.col("_at"), -F.col("_at"))).alias("_run"))
    rows = segments.join(best, ["recording_id", "seg_no"], "left")
    return rows.withColumns({"is_scroll": F.col("_run").isNotNull(), "scroll_start_idx": F.col("_run.run_start"), "scroll_end_idx": F.col("_run.run_end")}).drop("_run")


def segment_recordings(frames: DataFrame, shifts: DataFrame | None, config: Config, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Frames (recording_id, idx, ts, vec) and shifts between them to segments with their scroll runs.

    ``keep`` may store what is read more than once (pairs, islands) and give it back as stored.
    """
    pairs = frame_pairs(frames)
    if shifts is None:
        shifts = pairs.select("recording_id", "idx", *[F.lit(0.0).alias(c) for c in ("dx", "dy", "response")])
    pairs = pairs.join(shifts.select("recording_id", "idx", "dx", "dy", "response"), ["recording_id", "idx"])
    pairs = keep(pairs, "pairs")
    runs = scroll_runs(pairs, config)
    islands = keep(cut_islands(frames.select("recording_id", "idx", "ts", "vec"), classify_pairs(pairs, runs, config)), "islands")
    return annotate_scroll(fold_segments(islands, config), runs)
