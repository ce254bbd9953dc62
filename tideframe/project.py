"""A project folder: its manifest, the build over its recordings' frames, and what is written from it."""

from __future__ import annotations

import csv
import json
import os
import shutil
import struct
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import TRANSCRIPT_EXTENSIONS, VIDEO_EXTENSIONS, Config
from .operators import images, pairs, registry, segments, states
from .plans import views
from .sources import frames as sources
from .sources import measure
from .sources.pictures import SCHEMA, Pictures

FOLDER = ".tideframe"
SUMMARY = ["state_id", "label", "kind", "occurrences", "recordings", "total_seconds", "first_seen", "screenshot"]


class ProjectError(RuntimeError):
    pass


def now_iso() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


class Project:
    """Recordings, transcripts, states, screenshots and transitions of one folder, as one JSON tree."""

    def __init__(self, root: Path, manifest: dict):
        self.root, self.manifest = Path(root).resolve(), manifest

    # -- manifest -------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, root: str | Path, name: str, config: Config | None = None) -> Project:
        root = Path(root)
        if (root / FOLDER / "manifest.json").exists():
            raise ProjectError(f"{root} is a project already")
        empty = {k: [] for k in ("recordings", "transcripts", "states", "screenshots", "transitions")}
        p = cls(root, {"project": name, "schema_version": schemas.SCHEMA_VERSION, "created_at": now_iso(), "updated_at": now_iso(), "config": (config or Config()).to_dict(), **empty})
        p.save()
        return p

    @classmethod
    def load(cls, start: str | Path) -> Project:
        """The project at ``start`` or the nearest folder above it."""
        here = Path(start).resolve()
        for root in (here, *here.parents):
            if (root / FOLDER / "manifest.json").exists():
                data = json.loads((root / FOLDER / "manifest.json").read_text(encoding="utf-8"))
                if "project" not in data:
                    raise ProjectError(f"{root}: the manifest names no project")
                for t in data.get("transcripts", []):
                    if extra := set(t) - {"id", "filename", "path", "format", "bytes", "recording_id"}:
                        raise ProjectError(f"unknown key in a transcript: {', '.join(sorted(extra))}")
                for k in ("recordings", "transcripts", "states", "screenshots", "transitions"):
                    data.setdefault(k, [])
                data["config"] = Config.from_dict(data.get("config", {})).to_dict()
                return cls(root, data)
        raise ProjectError(f"no project at {here} or above; create one with init")

    def save(self) -> Path:
        self.manifest["updated_at"] = now_iso()
        path = self.root / FOLDER / "manifest.json"
        _write(path, json.dumps(self.manifest, indent=2))
        return path

    @property
    def config(self) -> Config:
        return Config.from_dict(self.manifest["config"])

    def entities(self, spark: SparkSession, name: str) -> DataFrame:
        """A list of the saved manifest as a DataFrame of its own schema."""
        tree = spark.read.schema(schemas.MANIFEST).json(f"file://{self.root}/{FOLDER}/manifest.json", multiLine=True)
        return tree.select(F.inline(name))

    # -- files ----------------------------------------------------------------------------------------------------

    def _stored(self, path: Path) -> str:
        path = path.resolve()
        return str(path.relative_to(self.root)) if path.is_relative_to(self.root) else str(path)

    def resolve(self, stored: str) -> Path:
        return Path(stored) if stored.startswith("/") else self.root / stored

    def recording(self, target: str) -> dict | None:
        """By id, else by file name."""
        rows = self.manifest["recordings"]
        return next((r for r in rows if r["id"] == target), None) or next((r for r in rows if r["filename"] == target), None)

    def add(self, file: str | Path, recording_for: str | None = None) -> dict:
        """Register a video or, by its extension, a transcript."""
        path = Path(file)
        if not path.exists():
            raise FileNotFoundError(str(path))
        ext = path.suffix.lower().lstrip(".")
        if ext in VIDEO_EXTENSIONS:
            return self._add_recording(path)
        if ext in TRANSCRIPT_EXTENSIONS:
            return self._add_transcript(path, ext, recording_for)
        raise ProjectError(f"unsupported file type .{ext}; supported: {', '.join(sorted((*VIDEO_EXTENSIONS, *TRANSCRIPT_EXTENSIONS)))}")

    def _add_recording(self, path: Path) -> dict:
        rows = self.manifest["recordings"]
        if any(r["filename"] == path.name for r in rows):
            raise ProjectError(f"a recording named {path.name} is there already")
        row = self._recording_row(f"rec_{len(rows) + 1:02d}", path.name, self._stored(path))
        rows.append(row)
        self.save()
        return row

    @staticmethod
    def _recording_row(ident: str, filename: str, stored: str) -> dict:
        empty = {"duration": 0.0, "fps": 0.0, "width": 0, "height": 0, "codec": ""}
        return {"id": ident, "filename": filename, "path": stored, "added_at": now_iso(), "status": "added", "metadata": empty, "transcript_id": None, "error": None}

    def _add_transcript(self, path: Path, ext: str, recording_for: str | None) -> dict:
        rec = self.recording(recording_for) if recording_for else None
        if recording_for and rec is None:
            raise ProjectError(f"no recording {recording_for}")
        rows = self.manifest["transcripts"]
        row = {"id": f"tr_{len(rows) + 1:02d}", "filename": path.name, "path": self._stored(path), "format": ext, "bytes": path.stat().st_size, "recording_id": rec["id"] if rec else None}
        rows.append(row)
        if rec:
            rec["transcript_id"] = row["id"]
        self.save()
        return row

    def add_all(self, spark: SparkSession, folder: str | Path) -> list[str]:
        """Register every video and transcript right below ``folder`` that isn't there yet; the ids that were given."""
        files = [(str(p.resolve()), p.stat().st_size) for p in sorted(Path(folder).iterdir()) if p.is_file()]
        if not files:
            return []
        recs, trs = self.manifest["recordings"], self.manifest["transcripts"]
        known = spark.createDataFrame([(r["filename"],) for r in recs], "filename string")
        new = registry.additions(spark.createDataFrame(files, "path string, bytes long"), known, len(recs), len(trs), F.lit(str(self.root)))
        rows = new.orderBy("kind", "id").collect()  # one row an entity of the manifest
        for r in rows:
            if r["kind"] == "recording":
                recs.append(self._recording_row(r["id"], r["filename"], r["stored"]))
            else:
                trs.append({"id": r["id"], "filename": r["filename"], "path": r["stored"], "format": r["format"], "bytes": r["bytes"], "recording_id": None})
        self.save()
        return [r["id"] for r in rows]

    # -- build ----------------------------------------------------------------------------------------------------

    def frames_root(self) -> Path:
        """Frames are cached by rate, so that a new rate doesn't read the old one's."""
        return self.root / FOLDER / "cache" / "frames" / f"fps={self.config.sample_fps:g}"

    def build(self, spark: SparkSession, force: bool = False, config: Config | None = None, log: Callable[[str], None] = lambda _: None) -> dict:
        """Sample what has no frames, segment all recordings, share states across them and write every output.

        ``log`` is told how far the build is. A recording that fails gets the status error and a warning; others are built.
        """
        began = time.time()
        if not self.manifest["recordings"]:
            raise ProjectError("no recordings; add one first")
        if config:
            self.manifest["config"] = config.to_dict()
        self.save()
        config, warnings = self.config, []
        images.get_embedder(config.embedder)  # one that can't be made is told before anything is done
        entries = spark.createDataFrame([(r["id"], r["status"]) for r in self.manifest["recordings"]], "id string, status string")
        open_ = {r["id"] for r in registry.unprocessed(entries, force).collect()}  # one row a recording
        todo = [r for r in self.manifest["recordings"] if r["id"] in open_]
        has_frames = lambda r: any((self.frames_root() / f"recording_id={r['id']}").glob("frame_*.png"))
        self._probe(spark, todo)
        self._sample(spark, [r for r in todo if not has_frames(r)])
        failed = {r["id"] for r in todo if r["error"] and not r["error"].startswith(sources.MISSING)}  # frames there or not
        known = [r["id"] for r in self.manifest["recordings"] if has_frames(r) and r["id"] not in failed]
        for r in todo:
            if r["id"] not in known:
                r.update(status="error", error=r["error"] or "no frames")
                warnings.append(f"{r['id']}: {r['error']}")
        if not known:
            self.save()
            raise ProjectError("no recording has frames")

        for r in todo:
            r["error"] = None if r["id"] in known else r["error"]
        log(f"{len(todo)} recordings to process, {len(known)} with frames")

        def kept(df: DataFrame, name: str) -> DataFrame:
            """``df`` as a table of the project, which later steps read instead of making it again."""
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        version = uuid.uuid4().hex
        work = self._tables(version)
        path = lambda c: F.regexp_replace(c, "^file:/+", "/")
        listed = sources.list_frames(spark, f"file://{self.frames_root()}", config.sample_fps).where(F.col("recording_id").isin(known))
        rows = measure.measure_frames(listed.withColumn("path", path("path")), config.embedder)
        measured = kept(rows.withColumn("shift", F.when(F.col("dx").isNotNull(), F.struct("dx", "dy", "response"))).drop("dx", "dy", "response"), "frames")
        bad = {r["recording_id"]: r["error"] for r in measured.where("error IS NOT NULL").groupBy("recording_id").agg(F.min_by("error", "idx").alias("error")).collect()}  # one row a recording
        for r in self.manifest["recordings"]:
            if r["id"] in bad:
                warnings.append(f"{r['id']}: {bad[r['id']]}")
                if r["id"] in open_:
                    r.update(status="error", error=bad[r["id"]])
        frames = measured.where(~F.col("recording_id").isin(list(bad))).drop("error")
        log("frames measured")
        shifts = frames.where("shift IS NOT NULL").select("recording_id", "idx", "shift.dx", "shift.dy", "shift.response")
        segs = kept(segments.segment_recordings(frames, shifts, config, kept), "segments")
        labelled = kept(states.labelled_segments(segs, config.merge_distance), "labelled")
        log("states found")

        shots, promoted = self._screenshots(spark, labelled, frames, config, warnings)
        occurrence_rows = states.occurrences(labelled, frames)
        state_rows = kept(states.states(occurrence_rows, shots), "states").orderBy("id")
        changes = states.state_changes(labelled)
        transition_rows = kept(states.transitions(changes, self._boundaries(changes, frames)), "transitions").orderBy("id")
        recs = spark.createDataFrame([(r["id"], r["filename"], float(r["metadata"]["duration"] or 0.0)) for r in self.manifest["recordings"]], "id string, filename string, duration double")

        plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  one row a state or transition
        self.manifest["states"], self.manifest["transitions"] = plain(state_rows), plain(transition_rows)
        self.manifest["screenshots"] = plain(shots.select("id", "state_id", "path", F.lit("state").alias("type"), "recording_id", "timestamp", "width", "height").orderBy("id"))
        for r in todo:
            if r["id"] in known and r["id"] not in bad:
                r.update(status="processed", error=None)
        counts = kept(views.recording_counts(frames, segs), "counts")
        timeline = plain(views.timeline(recs, occurrence_rows, state_rows).orderBy("recording_id"))
        totals = views.build_report(counts, state_rows, transition_rows).first().asDict()
        report = {
            "generated_at": now_iso(), "project": self.manifest["project"], "config": config.to_dict(), "totals": totals,
            "recordings": [{"id": r["recording_id"], "frames_sampled": r["frames_sampled"], "segments": r["segments"]} for r in counts.orderBy("recording_id").collect()],
            "kinds": {"states": self._kinds(state_rows), "transitions": self._kinds(transition_rows)}, "warnings": warnings, "elapsed_seconds": round(time.time() - began, 2),
        }
        out = self.root / FOLDER
        for pictures in promoted:  # from here on only moves and small files: what was built before is whole until now
            pictures.promote()
        self.manifest["tables"] = version
        _write(out / "timeline.json", json.dumps({"project": self.manifest["project"], "recordings": timeline}, indent=2))
        _write(out / "processing_report.json", json.dumps(report, indent=2))
        self.save()
        self._sweep(version)
        self.export(spark)
        return report

    def _tables(self, version: str) -> str:
        return f"file://{self.root}/{FOLDER}/cache/tables/{version}"

    def _sweep(self, version: str) -> None:
        """Remove the tables of builds before, and of builds that didn't end."""
        for old in (self.root / FOLDER / "cache" / "tables").iterdir():
            if old.name != version:
                shutil.rmtree(old) if old.is_dir() else old.unlink()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """frames, segments, labelled, states, transitions or counts of the last build that ended.

        A build writes a folder of its own and the manifest, which is replaced at once, names the one that is valid.
        """
        if not self.manifest.get("tables"):
            raise ProjectError("no build has ended yet")
        return spark.read.parquet(f"{self._tables(self.manifest['tables'])}/{name}")

    @staticmethod
    def _kinds(rows: DataFrame) -> dict[str, int]:
        return {r["kind"]: r["n"] for r in views.kind_counts(rows).orderBy("kind").collect()}  # a handful of kinds

    def _videos(self, spark: SparkSession, rows: list[dict]) -> DataFrame:
        return spark.createDataFrame([(r["id"], str(self.resolve(r["path"]))) for r in rows], "recording_id string, path string")

    def _probe(self, spark: SparkSession, rows: list[dict]) -> None:
        """Metadata of recordings, also of those whose frames are there; what goes wrong is kept as their error."""
        if not rows:
            return
        probed = {p["path"]: p for p in sources.probe_videos(self._videos(spark, rows)).collect()}  # one row a recording
        for r in rows:
            p = probed[str(self.resolve(r["path"]))]
            if p["metadata"]:
                r["metadata"] = p["metadata"].asDict()
            r["error"] = p["error"]

    def _sample(self, spark: SparkSession, rows: list[dict]) -> None:
        if rows:
            for s in sources.sample_videos(self._videos(spark, rows), str(self.frames_root().parent), self.config.sample_fps).where("error IS NOT NULL").collect():
                self.recording(s["recording_id"])["error"] = s["error"]

    def _screenshots(self, spark: SparkSession, labelled: DataFrame, frames: DataFrame, config: Config, warnings: list[str]) -> tuple[DataFrame, list[Pictures]]:
        """id, state_id, path, stitched, recording_id, timestamp, width, height of each state, and the pictures to be put in place.

        Executors write screenshots and stitched pictures to a staging folder.
        """
        shots, tall = (Pictures(spark, str(self.root / FOLDER / name)) for name in ("screenshots", "stitched"))
        canon = states.canonical_members(labelled).select("label", "state_id", "canonical.*")
        at = frames.select("recording_id", F.col("idx").alias("rep_idx"), "ts", "path")

        def sizes(batches):
            for pdf in batches:  # a PNG's width and height stand in its first bytes
                found = [struct.unpack(">II", measure.open_file(path, 24)[16:24]) for path in pdf["path"]]
                yield pdf.assign(width=[w for w, _ in found], height=[h for _, h in found])

        rows = canon.join(at, ["recording_id", "rep_idx"]).select("label", "state_id", "recording_id", "ts", "path")
        rows = rows.mapInPandas(sizes, "label int, state_id string, recording_id string, ts double, path string, width int, height int").collect()  # one row a state
        known = spark.createDataFrame([(r["state_id"], r["path"], r["height"]) for r in rows], "state_id string, path string, height int")
        shots.stage(known.repartition("state_id").select(F.concat("state_id", F.lit(".png")).alias("name"), F.col("path").alias("source"), F.lit(None).cast("binary").alias("data")))

        scrolls = canon.where("is_scroll").select("state_id", F.col("recording_id").alias("_r"), "scroll_start_idx", "scroll_end_idx").join(known.select("state_id", "height"), "state_id")
        part = frames.select("recording_id", "idx", "path", F.col("shift.dy").alias("dy"))
        run = scrolls.join(part, (F.col("_r") == F.col("recording_id")) & F.col("idx").between(F.col("scroll_start_idx"), F.col("scroll_end_idx")))
        run = run.withColumn("dy", F.when(F.col("idx") < F.col("scroll_end_idx"), F.col("dy")))
        plan = pairs.stitch_plan(run, "state_id", config.stitch_max_height_px)
        parts = run.select("state_id", "idx", "path").join(plan, ["state_id", "idx"])

        def save(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, data = pdf.sort_values("pos"), None
            try:
                picture = images.stitch([images.decode_png(measure.open_file(p)) for p in pdf["path"]], pdf["rows"].tolist())
                data = None if picture is None else images.png_bytes(picture)
            except Exception:  # the state keeps its screenshot
                data = None
            return pd.DataFrame({"name": [f"{pdf['state_id'].iloc[0]}.png"], "source": [None], "data": [data]})

        wanted = {r["state_id"] for r in scrolls.select("state_id").collect()}  # some of the manifest's states
        made = {n.removesuffix(".png") for n in tall.stage(parts.groupBy("state_id").applyInPandas(save, SCHEMA))} if wanted else set()
        warnings += [f"{k}: the scroll run can't be stitched" for k in sorted(wanted - made)]
        out = [
            (f"shot_{r['label'] + 1:04d}", r["state_id"], f"{FOLDER}/screenshots/{r['state_id']}.png", f"{FOLDER}/stitched/{r['state_id']}.png" if r["state_id"] in made else None, r["recording_id"], round(r["ts"], 2), r["width"], r["height"])
            for r in rows
        ]
        return spark.createDataFrame(out, "id string, state_id string, path string, stitched string, recording_id string, timestamp double, width int, height int"), [shots, tall]

    def _boundaries(self, changes: DataFrame, frames: DataFrame) -> DataFrame:
        """flat_no and the metrics of the two representative frames of each change of state, which are read where they are compared."""
        at = frames.select("recording_id", "idx", "path")
        side = lambda c: at.select("recording_id", F.col("idx").alias(f"{c}_idx"), F.col("path").alias(c))
        ends = changes.select("flat_no", "recording_id", "from_idx", "to_idx").join(side("from"), ["recording_id", "from_idx"]).join(side("to"), ["recording_id", "to_idx"])
        spread = ends.select("flat_no", "from", "to").repartition("flat_no")
        return spread.select("flat_no", images.boundary_column(F.col("from"), F.col("to"), measure.open_file).alias("m")).select("flat_no", "m.*")

    # -- reading --------------------------------------------------------------------------------------------------

    def export(self, spark: SparkSession) -> Path:
        """exports/summary.csv: one row per state, in state order."""
        path = self.root / FOLDER / "exports" / "summary.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = views.state_summary(self.entities(spark, "states")).orderBy("state_id").collect()
        with path.open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(SUMMARY)
            out.writerows([[r[c] for c in SUMMARY] for r in rows])
        return path

    def status(self) -> dict:
        recs = self.manifest["recordings"]
        return {
            "project": self.manifest["project"], "recordings": len(recs), "transcripts": len(self.manifest["transcripts"]), "states": len(self.manifest["states"]),
            "scroll_states": sum(s["kind"] == "scroll" for s in self.manifest["states"]), "transitions": len(self.manifest["transitions"]),
            "pending": ", ".join(r["filename"] for r in recs if r["status"] != "processed"),
        }

    def listing(self) -> dict[str, list[list[str]]]:
        """Rows to be shown: recordings, transcripts, and states with how often, in how many recordings, and when first."""
        shown = lambda *values: ["-" if v in (None, "") else str(v) for v in values]
        first = lambda s: min((o["start_tc"] for o in s["occurrences"]), default=None)
        return {
            "recordings": [shown(r["id"], r["filename"], r["status"], f"{r['metadata']['duration']:.0f}s" if r["metadata"]["duration"] else None, r["transcript_id"]) for r in self.manifest["recordings"]],
            "transcripts": [shown(t["id"], t["filename"], t["format"], t["recording_id"] or "(unassigned)") for t in self.manifest["transcripts"]],
            "states": [shown(s["id"], s["kind"], len(s["occurrences"]), len({o["recording_id"] for o in s["occurrences"]}), first(s)) for s in self.manifest["states"]],
        }

    def inspect(self, target: str) -> tuple[str, dict]:
        """A state by id, else a recording by id or file name, with its transitions."""
        for s in self.manifest["states"]:
            if s["id"] == target:
                return "state", s
        rec = self.recording(target)
        if rec is None:
            raise ProjectError(f"nothing is called {target}")
        return "recording", rec | {"transitions": [t for t in self.manifest["transitions"] if t["recording_id"] == rec["id"]]}


def analyze(spark: SparkSession, video: str | Path, out: str | Path | None = None, flags: dict | None = None, log: Callable[[str], None] = lambda _: None) -> dict:
    """Create the project and add the video if need be, then build all anew.

    ``flags`` (fields of the configuration, None where not given) are laid over the project's own configuration.
    """
    video = Path(video)
    if not video.exists():
        raise FileNotFoundError(str(video))
    root = Path(out) if out else Path.cwd() / f"{video.stem}_tideframe"
    project = Project.load(root) if (root / FOLDER / "manifest.json").exists() else Project.create(root, video.stem)
    if not any(r["filename"] == video.name for r in project.manifest["recordings"]):
        project.add(video)
    return project.build(spark, force=True, config=project.config.with_flags(**(flags or {})), log=log)
