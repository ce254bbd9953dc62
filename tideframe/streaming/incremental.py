"""Frames that arrive as a stream: per-frame and per-pair work as they come, global stages anew for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import Config
from ..operators import segments, states


def rebuild_on_arrival(frames: DataFrame, table: str, config: Config, publish: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that appends arriving frames to the Parquet folder ``table`` and, for each batch, hands ``publish`` the
    labelled segments of all frames so far.

    frames: recording_id, idx, ts, vec and, if known, the shift to the next frame as dx, dy and response; a null one, or none
    at all, is no scroll.

    States are shared by all recordings and depend on their order, so they are found anew and not patched. A batch that is
    run again after a failure replaces its own part of the table and gives the same result.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shift = [F.col(c).cast("double").alias(c) if c in batch.columns else F.lit(None).cast("double").alias(c) for c in ("dx", "dy", "response")]
        batch.select("recording_id", "idx", "ts", "vec", *shift).write.mode("overwrite").parquet(f"{table}/batch={number}")
        known = spark.read.option("basePath", table).parquet(table).drop("batch")
        shifts = known.select("recording_id", "idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dx", "dy", "response")])
        found = segments.segment_recordings(known.drop("dx", "dy", "response"), shifts, config)
        publish(states.labelled_segments(found, config.merge_distance), number)

    return frames.writeStream.foreachBatch(on_batch)
