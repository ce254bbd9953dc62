"""Neighbouring frames: distance, eligibility and class, cut islands, scroll runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numbers import cosine_distance


#: Frames of a range. Work in the order of frames is done by ranges, so that a recording of any length has many tasks.
RANGE = 16_384


def _range(idx: Column) -> Column:
    return F.floor(idx / RANGE)


def _in_order():
    return Window.partitionBy("recording_id", "_range").orderBy("idx")


def _with_border(rows: DataFrame, towards: int) -> DataFrame:
    """``rows`` with _range, and a second time those at the border that their neighbour range needs: its range's first frame goes
    to the range before (``towards`` -1), its last one to the range after (1)."""
    own = _range(F.col("idx"))
    at_border = F.col("idx") % RANGE == (0 if towards < 0 else RANGE - 1)
    return rows.withColumn("_range", F.explode(F.when(at_border, F.array(own, own + towards)).otherwise(F.array(own))))


def running_count(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """``rows`` (recording_id, idx, _range and ``flag``, 0 or 1) with ``name``, how many flags there are up to each row.

    Flags are counted within ranges, and the ranges' counts before each range are added: one row a range is all that is put in
    order over a whole recording.
    """
    each = rows.groupBy("recording_id", "_range").agg(F.sum(flag).alias("_n"))
    past = Window.partitionBy("recording_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("recording_id", "_range", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    local = rows.withColumn(name, F.sum(flag).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(before, ["recording_id", "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def frame_pairs(frames: DataFrame) -> DataFrame:
    """recording_id, idx, dist: each frame but a recording's last, with its distance to the next.

    frames: recording_id, idx (from 0 without gaps), vec. Of a range only the first frame goes to another range as well.
    """
    rows = _with_border(frames.select("recording_id", "idx", "vec"), -1).withColumn("_next", F.lead("vec").over(_in_order()))
    return rows.where(F.col("_next").isNotNull()).select("recording_id", "idx", cosine_distance(F.col("vec"), F.col("_next")).alias("dist"))


def is_scroll(config: Config) -> Column:
    """Predicate over response, dy and dx."""
    return (F.col("response") >= config.scroll_min_response) & (F.abs("dy") >= config.scroll_min_shift_px) & (F.abs("dx") <= config.scroll_max_horizontal_px)


def direction(dy: Column) -> Column:
    """1 for down, as where content doesn't move, -1 for up."""
    return F.when(dy >= 0, 1).otherwise(-1)


def scroll_runs(pairs: DataFrame, config: Config) -> DataFrame:
    """recording_id, start_idx, end_idx, direction: runs of scrolling pairs of one direction, from first to last frame.

    pairs: recording_id, idx, dx, dy, response and, if known, dist, by which a pair must change the picture. A pair that isn't
    there ends a run.
    """
    ok = is_scroll(config)
    if "dist" in pairs.columns:
        ok = ok & (F.col("dist") >= config.scroll_min_embedding_change)
    marked = pairs.select("recording_id", "idx", F.when(ok, direction(F.col("dy"))).otherwise(0).alias("_sign"))
    before = F.lag(F.struct("idx", "_sign")).over(_in_order())
    starts = before.isNull() | (before["_sign"] != F.col("_sign")) | (before["idx"] != F.col("idx") - 1)
    marked = _with_border(marked, 1).withColumn("_start", F.when(starts, 1).otherwise(0)).where(F.col("_range") == _range(F.col("idx")))
    marked = running_count(marked, "_start", "_run")
    runs = marked.where("_sign <> 0").groupBy("recording_id", "_run", "_sign").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.count(F.lit(1)).alias("_n"))
    return runs.where(F.col("_n") >= config.scroll_min_run).select("recording_id", "start_idx", "end_idx", F.col("_sign").alias("direction"))


def classify_pairs(pairs: DataFrame, runs: DataFrame, config: Config) -> DataFrame:
    """recording_id, idx, dist, kind: scroll within a run, else cut beyond the cut distance, else static."""
    inside = runs.select("recording_id", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)).alias("idx")).distinct().withColumn("_in", F.lit(True))
    kind = F.when(F.col("_in"), "scroll").when(F.col("dist") > config.cut_distance, "cut").otherwise("static")
    return pairs.join(inside, ["recording_id", "idx"], "left").select("recording_id", "idx", "dist", kind.alias("kind"))


def cut_islands(frames: DataFrame, classes: DataFrame) -> DataFrame:
    """``frames`` with seg_no, the number of cuts before each frame of its recording; numbers are made without the vectors."""
    cuts = classes.select("recording_id", (F.col("idx") + 1).alias("idx"), F.when(F.col("kind") == "cut", 1).otherwise(0).alias("_cut"))
    numbered = running_count(cuts.withColumn("_range", _range(F.col("idx"))), "_cut", "seg_no").select("recording_id", "idx", F.col("seg_no").cast("int").alias("seg_no"))
    return frames.join(numbered, ["recording_id", "idx"], "left").withColumn("seg_no", F.coalesce("seg_no", F.lit(0)))


def stitch_plan(frames: DataFrame, run: str, cap: int) -> DataFrame:
    """run, pos, idx, rows, total: which bottom rows of which frame make up the tall picture of each run.

    frames: run, idx, dy (the step to the next frame of the run, null for the last) and height. A run that goes up on the
    whole is read backwards. The first frame comes whole; each next one adds as many rows as its step has, up to its height,
    until the picture has ``cap`` rows; ``total`` is its height so far. Runs of one frame have no plan.
    """
    whole, forth = Window.partitionBy(run), Window.partitionBy(run).orderBy("idx")
    known = frames.withColumns({"_way": direction(F.sum(F.coalesce("dy", F.lit(0.0))).over(whole)), "_n": F.count(F.lit(1)).over(whole), "_before": F.lag("dy").over(forth)})
    known = known.withColumns({"_turn": F.col("_way") * F.col("idx"), "_step": F.when(F.col("_way") > 0, F.col("_before")).otherwise(F.col("dy"))})
    read = Window.partitionBy(run).orderBy("_turn")
    known = known.withColumn("pos", (F.row_number().over(read) - 1).cast("int"))
    rows = F.when(F.col("pos") == 0, F.col("height").cast("long")).otherwise(F.least(F.bround(F.abs("_step"), 0).cast("long"), F.col("height").cast("long")))
    known = known.withColumn("rows", rows).withColumn("total", F.sum("rows").over(read.rowsBetween(Window.unboundedPreceding, 0)))
    return known.where((F.col("_n") > 1) & ((F.col("pos") <= 1) | (F.col("total") - F.col("rows") < cap))).select(run, "pos", "idx", "rows", "total")
