"""Frame pictures on any file system Spark reads, and video probing where the tools are installed."""

from __future__ import annotations

import json
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import frame_time
from ..functions.text import frame_number


#: How the error of a missing tool begins, which isn't the recording's fault.
MISSING = "not found on PATH"


class ToolError(RuntimeError):
    pass


def ensure_tools(*names: str) -> None:
    """All of ffmpeg and ffprobe, or the tools named, must be on the path."""
    missing = [n for n in names or ("ffmpeg", "ffprobe") if shutil.which(n) is None]
    if missing:
        raise ToolError(f"{MISSING}: {', '.join(missing)}")


def list_frames(spark: SparkSession, root: str, fps: float) -> DataFrame:
    """recording_id, idx (from 0), ts, path of frame_NNNNNN.png files below recording_id=... folders. Pixels aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.png").option("recursiveFileLookup", "true").load(root).select("path")
    rows = files.withColumns({"recording_id": F.regexp_extract("path", "recording_id=([^/]+)/", 1), "number": frame_number(F.col("path"))})
    idx = (F.row_number().over(Window.partitionBy("recording_id").orderBy("number")) - 1).cast("int")
    return rows.where("number IS NOT NULL").select("recording_id", idx.alias("idx"), frame_time(F.col("number"), fps).alias("ts"), "path")


def read_pictures(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path and ``image`` (BGR) of all frames below a folder, or of a list of files; one that can't be decoded has an image
    of height -1."""
    return spark.read.format("image").option("pathGlobFilter", "frame_*.png").option("recursiveFileLookup", "true").load(root).select(F.col("image.origin").alias("path"), "image")


def parse_probe(text: str) -> tuple[float, float, int, int, str]:
    """(duration, fps, width, height, codec) of a probe's JSON: the first video stream; what is absent is 0 or empty.

    fps is the base rate, of which all times of a recording with a varying rate are multiples, not its average.
    """
    data = json.loads(text or "{}")
    stream = next((s for s in data.get("streams", []) if s.get("codec_type") == "video"), {})
    top, _, low = str(stream.get("r_frame_rate") or "").partition("/")
    try:
        fps = round(float(top) / float(low), 3)
    except (ValueError, ZeroDivisionError):
        fps = 0.0
    try:
        duration = float(data.get("format", {}).get("duration") or 0)
    except ValueError:
        duration = 0.0
    return duration, fps, int(stream.get("width") or 0), int(stream.get("height") or 0), str(stream.get("codec_name") or "")


def probe_videos(paths: DataFrame) -> DataFrame:
    """path, metadata, error of each row's ``path``; a file that can't be probed has an error and no metadata."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    ensure_tools("ffprobe")
                    out = subprocess.run(["ffprobe", "-v", "error", "-show_streams", "-show_format", "-of", "json", path], capture_output=True, text=True, check=True).stdout
                    rows.append((path, *parse_probe(out), None))
                except (ToolError, subprocess.CalledProcessError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["path", "duration", "fps", "width", "height", "codec", "error"])

    found = paths.select("path").mapInPandas(run, "path string, duration double, fps double, width int, height int, codec string, error string")
    return found.select("path", F.when(F.col("error").isNull(), F.struct("duration", "fps", "width", "height", "codec")).alias("metadata"), "error")


def sample_videos(videos: DataFrame, out_root: str, fps: float) -> DataFrame:
    """Write frame_NNNNNN.png of each (recording_id, path) below out_root/fps=.../recording_id=..., a folder all can reach.

    Old frames of the recording go first. Returns recording_id, frames, error; one recording's failure leaves the others.
    """

    def run(batches):
        from pathlib import Path

        import pandas as pd

        for pdf in batches:
            rows = []
            for rec, path in zip(pdf["recording_id"], pdf["path"], strict=True):
                folder = Path(out_root) / f"fps={fps:g}" / f"recording_id={rec}"
                try:
                    ensure_tools("ffmpeg")
                    folder.mkdir(parents=True, exist_ok=True)
                    for old in folder.glob("frame_*.png"):
                        old.unlink()
                    subprocess.run(["ffmpeg", "-v", "error", "-i", path, "-vf", f"fps={fps:g}", str(folder / "frame_%06d.png")], capture_output=True, check=True)
                    rows.append((rec, len(list(folder.glob("frame_*.png"))), None))
                except (ToolError, OSError, subprocess.CalledProcessError) as e:
                    rows.append((rec, 0, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["recording_id", "frames", "error"])

    return videos.select("recording_id", "path").repartition("recording_id").mapInPandas(run, "recording_id string, frames int, error string")
