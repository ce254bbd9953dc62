"""String columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TRANSCRIPT_EXTENSIONS, VIDEO_EXTENSIONS


#: Console colours of statuses.
STATUS_COLOURS = {"processed": 32, "error": 31, "added": 33}


def timecode(seconds: Column) -> Column:
    """HH:MM:SS of seconds rounded half to even, never below zero; hours may take more digits."""
    s = F.greatest(F.bround(seconds.cast("double")), F.lit(0.0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def slugify(text: Column) -> Column:
    """Lower case, only word characters, dashes for spaces and underscores; ``item`` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("item"))


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, length)


def relative_path(path: Column, base: Column) -> Column:
    """Path below base, else the path as it is; both resolved beforehand."""
    root = F.concat(base, F.lit("/"))
    return F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).when(path == base, F.lit(".")).otherwise(path)


def resolved_path(path: Column, base: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", base, path))


def frame_number(path: Column) -> Column:
    return F.regexp_extract(path, r"frame_(\d+)\.png$", 1).try_cast("int")


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    """recording, transcript or null for an unsupported file."""
    e = extension(path)
    return F.when(e.isin(*VIDEO_EXTENSIONS), F.lit("recording")).when(e.isin(*TRANSCRIPT_EXTENSIONS), F.lit("transcript"))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """prefix_0001; a number with more digits than ``width`` is written in full."""
    return F.format_string(f"{prefix}_%0{width}d", number.cast("bigint"))


def display(value: Column, blank: str = "-") -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(blank))
