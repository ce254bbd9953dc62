"""Derived views: timelines, the summary table, the report, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dedup_ratio, rounded
from ..functions.text import timecode


def timeline_events(recordings: DataFrame, occurrence_rows: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row per event of each recording, in order of event_no; a recording without events has one row of nulls.

    recordings: id, filename, duration; kinds: state id and kind, without which every state is a screen.
    """
    rows = occurrence_rows if kinds is None else occurrence_rows.join(kinds.select(F.col("id").alias("state_id"), "kind"), "state_id", "left")
    kind = F.lit("screen") if kinds is None else F.col("kind")
    event = F.struct("start", "label", F.struct(F.col("start_tc").alias("timestamp"), F.col("start").alias("seconds"), "state_id", F.col("state_id").alias("event"), kind.alias("kind"), "confidence").alias("e"))
    events = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    out = recordings.join(events, recordings["id"] == events["recording_id"], "left")
    out = out.select(F.col("id").alias("recording_id"), "filename", "duration", timecode(F.col("duration")).alias("duration_tc"), F.posexplode_outer("events").alias("event_no", "_e"))
    return out.select("recording_id", "filename", "duration", "duration_tc", "event_no", "_e.e.*")


def timeline(recordings: DataFrame, occurrence_rows: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row per recording with its events nested; an empty array where there are none."""
    flat = timeline_events(recordings, occurrence_rows, kinds)
    fields = ("timestamp", "seconds", "state_id", "event", "kind", "confidence")
    sort = F.array_sort(F.collect_list(F.when(F.col("event_no").isNotNull(), F.struct("event_no", *fields))))
    out = flat.groupBy("recording_id", "filename", "duration", "duration_tc").agg(sort.alias("_e"))
    return out.withColumn("events", F.transform("_e", lambda e: F.struct(*[e[f].alias(f) for f in fields]))).drop("_e")


def state_summary(state_rows: DataFrame) -> DataFrame:
    """One row per state, as the summary file has it."""
    seconds = F.aggregate("occurrences", F.lit(0.0), lambda s, o: s + F.greatest(o["end"] - o["start"], F.lit(0.0)))
    return state_rows.select(
        F.col("id").alias("state_id"), "label", "kind", F.size("occurrences").cast("long").alias("occurrences"),
        F.size(F.array_distinct(F.transform("occurrences", lambda o: o["recording_id"]))).cast("long").alias("recordings"), rounded(seconds, 1).alias("total_seconds"),
        F.coalesce(F.array_min(F.transform("occurrences", lambda o: o["start_tc"])), F.lit("")).alias("first_seen"),
        F.coalesce(F.nullif("stitched_screenshot", F.lit("")), "representative_screenshot").alias("screenshot"),
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    """kind, n: how many states, or transitions, of each kind there are."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def recording_counts(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, frames_sampled, segments."""
    f = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames_sampled"))
    s = segments.groupBy("recording_id").agg(F.count(F.lit(1)).alias("segments"))
    return f.join(s, "recording_id", "left").select("recording_id", "frames_sampled", F.coalesce("segments", F.lit(0)).alias("segments"))


def build_report(counts: DataFrame, state_rows: DataFrame, transition_rows: DataFrame) -> DataFrame:
    """One row of totals. counts: of :func:`recording_counts`."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()])
    totals = one(counts, recordings_processed=F.count(F.lit(1)), frames_sampled=F.coalesce(F.sum("frames_sampled"), F.lit(0)), segments=F.coalesce(F.sum("segments"), F.lit(0)))
    totals = totals.join(one(state_rows, states=F.count(F.lit(1)), scroll_states=F.count_if(F.col("kind") == "scroll"))).join(one(transition_rows, transitions=F.count(F.lit(1))))
    return totals.withColumn("dedup_ratio", dedup_ratio(F.col("states"), F.col("segments")))
