"""Final segments of recordings that arrive as a stream: keyed state per recording, each segment told once.

Frames are taken in order of their numbers. A pair of frames that scrolls waits until its run is long enough or over, an island
until the next one is known, a segment until one follows that doesn't join it; what these hold back is the state, together with
the frames of segments that aren't final. A recording ends with a frame that says so, or when none has come for some time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators.segments import Island, SegmentFold

OUT = (
    "recording_id string, seg_no int, start_idx int, end_idx int, start_time double, end_time double, rep_idx int, centroid array<double>, confidence double,"
    " is_scroll boolean, scroll_start_idx int, scroll_end_idx int"
)
_FRAME = "idx int, ts double, vec array<double>"
_EARLY = _FRAME + ", dx double, dy double, response double, last boolean"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RecordingFold:
    """Frames of one recording in order to the ranges of its final segments; holds a few sums, not frames."""

    def __init__(self, recording_id: str, config: Config):
        self._id, self._config, self._fold = recording_id, config, SegmentFold(config)
        self.next_idx, self.segments, self.early, self.closed = 0, 0, 0, False
        self._islands, self._island = 0, None
        self._before = None
        self._sign, self._run_start, self._run_length, self._undecided = 0, 0, 0, []
        self._runs: list[tuple[int, int]] = []

    def add(self, idx: int, ts: float, vec: np.ndarray, dx: float, dy: float, response: float) -> list[Island]:
        """Segments that this frame makes final. dx, dy, response: the shift to the next frame, 0 if none is known."""
        frame, before, self._before = (idx, ts, vec), self._before, (idx, vec, dx, dy, response)
        self.next_idx = idx + 1
        if before is None:
            self._island = self._alone(frame)
            return []
        at, old, dx, dy, response = before
        c, dist = self._config, float(1.0 - old @ vec)
        scrolls = response >= c.scroll_min_response and abs(dy) >= c.scroll_min_shift_px and abs(dx) <= c.scroll_max_horizontal_px and dist >= c.scroll_min_embedding_change
        sign = (1 if dy >= 0 else -1) if scrolls else 0
        out = []
        if sign != self._sign:
            out = self._end_run(at)
            self._sign, self._run_start, self._run_length = sign, at, 0
        self._run_length += 1
        if sign and self._run_length < c.scroll_min_run:
            self._undecided.append((dist, frame))
        elif sign:
            for _, waiting in (*self._undecided, (dist, frame)):
                out += self._go_on(waiting, False)
            self._undecided = []
        else:
            out += self._go_on(frame, dist > c.cut_distance)
        return out

    def close(self) -> list[Island]:
        """Segments that are left when the recording ends."""
        self.closed = True
        if self._before is None:
            return []
        out = self._end_run(self._before[0])
        for final, _, _ in (*self._fold.add(self._island), *self._fold.close()):
            out.append(final)
        return out

    def longest_run(self, segment: Island) -> tuple[int, int] | None:
        """The longest scroll run inside a final segment, the earliest of equals; runs that lie before its end are let go."""
        inside = [r for r in self._runs if r[0] >= segment.start_idx and r[1] <= segment.end_idx]
        self._runs = [r for r in self._runs if r[1] > segment.end_idx]
        return max(inside, key=lambda r: (r[1] - r[0], -r[0]), default=None)

    def _alone(self, frame: tuple) -> Island:
        idx, ts, vec = frame
        return Island(self._id, self._islands, 1, idx, idx, ts, ts, vec)

    def _end_run(self, end: int) -> list[Island]:
        out, undecided, self._undecided = [], self._undecided, []
        for dist, frame in undecided:  # too short a run: its pairs are like any
            out += self._go_on(frame, dist > self._config.cut_distance)
        if self._sign and self._run_length >= self._config.scroll_min_run:
            self._runs.append((self._run_start, end))
        return out

    def _go_on(self, frame: tuple, cut: bool) -> list[Island]:
        if not cut:
            self._island = self._island.with_(self._alone(frame))
            return []
        whole, self._islands = self._island, self._islands + 1
        self._island = self._alone(frame)
        return [final for final, _, _ in self._fold.add(whole)]


class _Segments(StatefulProcessor):
    def __init__(self, config: Config, idle_ms: int | None):
        self._config, self._idle = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._fold = handle.getValueState("fold", "state binary")
        self._frames = handle.getListState("frames", _FRAME)  # of segments that aren't final; added to, not written anew
        self._early = handle.getListState("early", _EARLY)  # frames with a gap before them

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = self._load(key[0])
        if fold.closed:
            return
        now = [tuple(r) for pdf in rows for r in pdf[["idx", "ts", "vec", "dx", "dy", "response", "last"]].itertuples(index=False, name=None)]
        if fold.early:
            now += [tuple(r) for r in self._early.get()]
        self._early.clear()
        frames, early, out = [], [], []
        for idx, ts, vec, dx, dy, response, last in sorted(now, key=lambda r: r[0]):
            if fold.closed or idx < fold.next_idx:
                continue  # told before
            if idx > fold.next_idx:
                early.append((int(idx), float(ts), [float(x) for x in vec], float(dx), float(dy), float(response), bool(last)))
                continue
            vec = np.asarray(vec, float)
            frames.append((int(idx), float(ts), vec.tolist()))
            out += fold.add(int(idx), float(ts), vec, dx, dy, response)
            if last:
                out += fold.close()
        if frames:
            self._frames.appendList(frames)
        if early and not fold.closed:
            self._early.put(early)
        fold.early = len(early)
        told = self._told(key[0], fold, out)
        if self._idle is not None:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            if not fold.closed:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        self._store(fold)
        if told is not None:
            yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold = self._load(key[0])
        if fold.closed:
            return
        told = self._told(key[0], fold, fold.close())
        self._early.clear()
        self._store(fold)
        if told is not None:
            yield told

    def _load(self, recording_id: str) -> RecordingFold:
        return pickle.loads(self._fold.get()[0]) if self._fold.exists() else RecordingFold(recording_id, self._config)

    def _store(self, fold: RecordingFold) -> None:
        if fold.closed:  # what late frames meet
            closed = RecordingFold(fold._id, self._config)
            closed.closed, fold = True, closed
        self._fold.update((pickle.dumps(fold),))

    def _told(self, recording_id: str, fold: RecordingFold, final: list[Island]) -> pd.DataFrame | None:
        """Rows of final segments, whose frames are let go."""
        if not final:
            return None
        held = [tuple(r) for r in self._frames.get()]
        idx, vecs = np.array([r[0] for r in held]), np.array([r[2] for r in held], float)
        rows = []
        for s in final:
            own = (idx >= s.start_idx) & (idx <= s.end_idx)
            c, run = s.centroid(), fold.longest_run(s)
            d = 1.0 - vecs[own] @ c
            start, end = run or (None, None)
            rows.append((recording_id, fold.segments, s.start_idx, s.end_idx, s.start_time, s.end_time, int(idx[own][d.argmin()]), c.tolist(), float(min(max(1.0 - d.mean(), 0.0), 1.0)), run is not None, start, end))
            fold.segments += 1
        left = [r for r in held if r[0] > final[-1].end_idx]
        self._frames.clear()
        if left and not fold.closed:
            self._frames.put(left)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        return out.astype({c: "Int32" for c in ("scroll_start_idx", "scroll_end_idx")})


def final_segments(frames: DataFrame, config: Config, idle_ms: int | None = None) -> DataFrame:
    """A stream of segments, as :func:`~tideframe.operators.segments.segment_recordings` finds them, each told once and for good.

    frames: a stream of recording_id, idx (from 0 without gaps), ts, vec and, if known, dx, dy, response (the shift to the next
    frame; null is no scroll) and last (the recording ends with this frame). Frames may come in any order: one with a gap
    before it waits, one that came already counts once. With ``idle_ms`` a recording without a last frame ends so long after its
    latest one, and what waits behind a gap then, or comes later, is left out; such a query runs batches for its timers as long as
    it lives, so it needs a trigger by time and not one for what is available now. State per recording: the frames of segments that aren't final and
    a few sums. The session needs the settings in ``STORE``; rows without a recording_id are left out.
    """
    shift = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in frames.columns else F.lit(0.0).alias(c) for c in ("dx", "dy", "response")]
    last = F.coalesce(F.col("last"), F.lit(False)).alias("last") if "last" in frames.columns else F.lit(False).alias("last")
    rows = frames.where("recording_id IS NOT NULL").select("recording_id", "idx", "ts", F.col("vec").cast("array<double>").alias("vec"), *shift, last)
    return rows.groupBy("recording_id").transformWithStateInPandas(_Segments(config, idle_ms), OUT, "append", "none" if idle_ms is None else "processingTime")
