"""Files and recordings of a project: what is new, what belongs together, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, file_kind, padded_id, relative_path


def unprocessed(recordings: DataFrame, force: bool = False) -> DataFrame:
    """Recordings (status and others) to be processed: all if forced, else those whose status isn't ``processed``."""
    return recordings.where(F.lit(force) | ~F.col("status").eqNullSafe("processed"))


def joined_names(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by, names: the distinct names of each group in order, joined by a comma and a space."""
    return rows.groupBy(by).agg(F.concat_ws(", ", F.array_sort(F.collect_set(name))).alias("names"))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no row of ``others`` has: recordings without frames, transcripts without a recording."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def known_already(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key some row of ``others`` has."""
    return rows.join(others.select(key).distinct(), key, "left_semi")


def resolve_targets(rows: DataFrame, target: str, recordings: DataFrame) -> DataFrame:
    """``rows`` with ``recording``: the id that ``target`` names, or else the first id of a recording of that file name.

    recordings: id, filename. Null where nothing is called so.
    """
    by_id = recordings.select(F.col("id").cast("string").alias("_target"), F.col("id").alias("_by_id")).distinct()
    by_name = recordings.groupBy(F.col("filename").alias("_target")).agg(F.min("id").alias("_by_name"))
    out = rows.withColumn("_target", F.col(target)).join(by_id, "_target", "left").join(by_name, "_target", "left")
    return out.withColumn("recording", F.coalesce("_by_id", "_by_name")).drop("_target", "_by_id", "_by_name")


def sort_files(files: DataFrame, root: Column) -> DataFrame:
    """``files`` (path) with filename, format, stored (below root as relative) and kind, null for an unsupported file."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.withColumns({"filename": name, "format": extension(F.col("path")), "stored": relative_path(F.col("path"), root), "kind": file_kind(F.col("path"))})


def additions(files: DataFrame, recordings: DataFrame, n_recordings: int, n_transcripts: int, root: Column) -> DataFrame:
    """What registering ``files`` (path, bytes) in order of path adds: kind, id, filename, stored, format, bytes.

    Unsupported files are left out, and recordings of a file name that is there already; of several new ones the first path
    stays. Ids go on from the numbers that there are.
    """
    known = sort_files(files, root).where("kind IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("kind", "filename").orderBy("path"))
    fresh = without(known.where("kind = 'recording'"), recordings, "filename").withColumn("_first", first).where("_first = 1").drop("_first")
    out = []
    for kind, prefix, n, rows in (("recording", "rec", n_recordings, fresh), ("transcript", "tr", n_transcripts, known.where("kind = 'transcript'"))):
        number = F.row_number().over(Window.partitionBy("kind").orderBy("path")) + n  # bounded by the manifest that takes them in
        out.append(rows.select("kind", padded_id(prefix, number, 2).alias("id"), "filename", "stored", "format", "bytes"))
    return out[0].unionByName(out[1])
