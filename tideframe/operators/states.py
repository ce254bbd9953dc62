"""Shared states: segments labelled by the greedy fold, states with occurrences, transitions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import padded_id, timecode
from .clustering import greedy_clusters


def flat_order(segments: DataFrame) -> DataFrame:
    """``segments`` with flat_no from 0, by recording and place: one window per recording on top of per-recording counts."""
    sizes = segments.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("recording_id", F.coalesce(F.sum("_n").over(Window.orderBy("recording_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_no")) - 1
    return segments.join(before, "recording_id").withColumn("flat_no", (F.col("_before") + inside).cast("int")).drop("_before")


def labelled_segments(segments: DataFrame, merge_distance: float) -> DataFrame:
    """``segments`` with flat_no, label and state_id."""
    flat = flat_order(segments)
    out = flat.join(greedy_clusters(flat, merge_distance), "flat_no").withColumn("state_id", padded_id("state", F.col("label") + 1, 4))
    return out.repartition("recording_id")  # what several views read is then made once


def canonical_members(labelled: DataFrame) -> DataFrame:
    """label, state_id and the member of highest confidence, the first of equals, as struct ``canonical``."""
    member = F.struct("flat_no", "recording_id", "seg_no", "rep_idx", "start_idx", "end_idx", "is_scroll", "scroll_start_idx", "scroll_end_idx", "confidence")
    return labelled.groupBy("label", "state_id").agg(F.max_by(member, F.struct("confidence", -F.col("flat_no"))).alias("canonical"))


def occurrences(labelled: DataFrame, frames: DataFrame) -> DataFrame:
    """state_id and the fields of an occurrence, one row each."""
    at = frames.select("recording_id", F.col("idx").alias("rep_idx"), F.col("ts").alias("_rep_ts"))
    rows = labelled.join(at, ["recording_id", "rep_idx"])
    return rows.select(
        "state_id", "label", "recording_id", rounded(F.col("start_time"), 2).alias("start"), rounded(F.col("end_time"), 2).alias("end"), timecode(F.col("start_time")).alias("start_tc"),
        timecode(F.col("end_time")).alias("end_tc"), rounded(F.col("_rep_ts"), 2).alias("representative_timestamp"), rounded(F.col("confidence"), 3).alias("confidence"), "flat_no",
    )


def states(occurrence_rows: DataFrame, screenshots: DataFrame | None = None) -> DataFrame:
    """id, label, representative_screenshot, kind, stitched_screenshot and sorted occurrences of each state.

    screenshots: state_id, path, stitched (null unless a stitched picture was made, which makes the state a scroll).
    """
    fields = ("recording_id", "start", "end", "start_tc", "end_tc", "representative_timestamp", "confidence")
    ordered = F.array_sort(F.collect_list(F.struct("recording_id", "start", "flat_no", *[f for f in fields if f not in ("recording_id", "start")])))
    out = occurrence_rows.groupBy("state_id").agg(F.transform(ordered, lambda o: F.struct(*[o[f].alias(f) for f in fields])).alias("occurrences"))
    if screenshots is None:
        out = out.withColumns({"path": F.concat(F.lit("screenshots/"), "state_id", F.lit(".png")), "stitched": F.lit(None).cast("string")})
    else:
        out = out.join(screenshots.select("state_id", "path", "stitched"), "state_id", "left")
    kind = F.when(F.col("stitched").isNotNull(), "scroll").otherwise("screen")
    return out.select(F.col("state_id").alias("id"), F.col("state_id").alias("label"), F.col("path").alias("representative_screenshot"), kind.alias("kind"), F.col("stitched").alias("stitched_screenshot"), "occurrences")


def state_changes(labelled: DataFrame) -> DataFrame:
    """Neighbouring segments of a recording in different states: from_state, to_state, their representative frames, the time."""
    w = Window.partitionBy("recording_id").orderBy("start_time", "seg_no")
    rows = labelled.select("recording_id", "seg_no", "state_id", "start_time", "rep_idx", "flat_no").withColumns({f"_next_{c}": F.lead(c).over(w) for c in ("state_id", "start_time", "rep_idx", "flat_no")})
    rows = rows.where("_next_state_id IS NOT NULL AND _next_state_id <> state_id")
    return rows.select("recording_id", F.col("state_id").alias("from_state"), F.col("_next_state_id").alias("to_state"), F.col("rep_idx").alias("from_idx"), F.col("_next_rep_idx").alias("to_idx"), F.col("_next_start_time").alias("at"), F.col("_next_flat_no").alias("flat_no"))


def boundary_kind(border: Column, drop: Column, top: Column, middle: Column) -> Column:
    """struct(kind, confidence) from a boundary's metrics; null metrics mean that a frame couldn't be read."""
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when(border.isNull(), pair("unknown", 0.3)).when((border > 0.85) & (drop > 8.0), pair("modal", 0.6))
        .when((top > 0.9) & (middle < 0.6) & (F.abs(drop) < 8.0), pair("tab", 0.5)).otherwise(pair("navigation", 0.7))
    )


def transitions(changes: DataFrame, metrics: DataFrame | None = None, keep_number: bool = False) -> DataFrame:
    """Numbered transitions, by recording and time. metrics: flat_no, border, drop, top, middle; without, all are unknown.

    ``keep_number`` adds flat_no, the number of the segment after the change.
    """
    if metrics is None:
        rows = changes.withColumns({c: F.lit(None).cast("double") for c in ("border", "drop", "top", "middle")})
    else:
        rows = changes.join(metrics, "flat_no", "left")
    rows = rows.withColumn("_k", boundary_kind(F.col("border"), F.col("drop"), F.col("top"), F.col("middle")))
    sizes = changes.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("recording_id", F.coalesce(F.sum("_n").over(Window.orderBy("recording_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("recording_id").orderBy("flat_no"))
    rows = rows.join(before, "recording_id")
    return rows.select(padded_id("trans", number, 4).alias("id"), "recording_id", "from_state", "to_state", rounded(F.col("at"), 2).alias("at"), timecode(F.col("at")).alias("at_tc"), F.col("_k.kind").alias("kind"), rounded(F.col("_k.confidence"), 3).alias("confidence"), *[c for c in ("flat_no",) if keep_number])


def workflow_graph(transition_rows: DataFrame) -> DataFrame:
    """from_state, to_state, n: the edges of all transitions."""
    return transition_rows.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
