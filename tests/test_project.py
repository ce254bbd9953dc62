import csv
import json
import os

import numpy as np
import pytest

from tideframe.cli import main
from tideframe.config import Config
from tideframe.operators import images
from tideframe.operators.images import png_bytes
from tideframe.project import Project, ProjectError, analyze
from tideframe.sources import frames as sources

H, W = 240, 320


def screen(seed):
    """Blocks of colour, no two screens alike."""
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (12, 16, 3), dtype=np.uint8), np.ones((20, 20, 1), np.uint8))


def noisy(picture, k):
    out = picture.copy()
    y, x = 20 + 9 * k % 180, 30 + 17 * k % 250
    out[y : y + 8, x : x + 6] = 255
    if k % 2:
        out[100:108, 10:12] = 0
    return out


@pytest.fixture(scope="module")
def golden(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("golden")
    p = Project.create(root, "demo")
    for n in ("a.mp4", "b.MP4"):
        (root / n).write_bytes(b"x")
        p.add(root / n)
    rng = np.random.default_rng(9)
    page = np.repeat(np.kron(rng.integers(0, 256, (90, 40), dtype=np.uint8), np.ones((8, 8), np.uint8))[:, :, None], 3, axis=2)
    dash, settings, reports = screen(1), screen(2), screen(3)
    scroll = [page[k * 56 : k * 56 + H] for k in range(8)]
    plans = {"rec_01": [dash] * 4 + [settings] * 3 + scroll + [reports] * 3, "rec_02": [dash] * 3 + [reports] * 3}
    for rec, shown in plans.items():
        folder = p.frames_root() / f"recording_id={rec}"
        folder.mkdir(parents=True)
        for k, picture in enumerate(shown):
            (folder / f"frame_{k + 1:06d}.png").write_bytes(png_bytes(noisy(picture, k)))
    report = p.build(spark)
    return root, report


def test_totals(golden):
    _, report = golden
    t = report["totals"]
    assert (t["recordings_processed"], t["frames_sampled"], t["segments"], t["states"], t["scroll_states"], t["transitions"]) == (2, 24, 6, 4, 1, 4)
    assert t["dedup_ratio"] == 0.333 and report["warnings"] == []


def test_states_and_graph(golden):
    root, _ = golden
    m = json.loads((root / ".tideframe" / "manifest.json").read_text())
    assert [(s["id"], s["kind"], len(s["occurrences"])) for s in m["states"]] == [("state_0001", "screen", 2), ("state_0002", "screen", 1), ("state_0003", "scroll", 1), ("state_0004", "screen", 2)]
    assert [(t["from_state"][-1], t["to_state"][-1]) for t in m["transitions"]] == [("1", "2"), ("2", "3"), ("3", "4"), ("1", "4")]
    assert [(s["width"], s["height"]) for s in m["screenshots"]] == [(W, H)] * 4
    assert (root / m["states"][2]["stitched_screenshot"]).stat().st_size > 0


def test_timeline_and_summary(golden):
    root, _ = golden
    timeline = json.loads((root / ".tideframe" / "timeline.json").read_text())
    assert [[e["state_id"][-1] for e in r["events"]] for r in timeline["recordings"]] == [["1", "2", "3", "4"], ["1", "4"]]
    rows = list(csv.reader((root / ".tideframe" / "exports" / "summary.csv").open(newline="")))
    assert rows[0][0] == "state_id" and [r[3] for r in rows[1:]] == ["2", "1", "1", "2"] and rows[3][7] == ".tideframe/stitched/state_0003.png"


def test_manifest_round_trip(golden, spark):
    root, _ = golden
    p = Project.load(root / "sub")
    assert p.entities(spark, "states").count() == 4 and p.entities(spark, "recordings").where("status = 'processed'").count() == 2
    assert p.inspect("state_0003")[0] == "state" and len(p.inspect("b.MP4")[1]["transitions"]) == 1


def test_a_recording_without_frames_leaves_the_others(golden, spark):
    root, _ = golden
    p = Project.load(root)
    (root / "c.mp4").write_bytes(b"x")
    p.add(root / "c.mp4")
    said = []
    report = p.build(spark, log=said.append)
    assert [r["status"] for r in p.manifest["recordings"]] == ["processed", "processed", "error"] and said
    assert report["totals"]["states"] == 4 and any("rec_03" in w for w in report["warnings"])
    last = json.loads((root / ".tideframe" / "timeline.json").read_text())["recordings"][-1]
    assert (last["recording_id"], last["events"]) == ("rec_03", [])


def test_commands(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert main(["status"]) == 1
    assert main(["init", "demo", "--fps", "2", "--cut-distance", "0.3"]) == 0 and main(["init", "demo"]) == 1
    tmp_path /= "demo"
    monkeypatch.chdir(tmp_path)
    (tmp_path / "rec_02").mkdir()
    for n in ("one.mp4", "two.mp4", "note.md", "x.xyz"):
        (tmp_path / n).write_text("abc")
    assert [main(["add", n]) for n in ("one.mp4", "one.mp4", "x.xyz", "gone.mp4", "two.mp4")] == [0, 1, 1, 1, 0]
    assert main(["add", "note.md", "--for", "two.mp4"]) == 0
    p = Project.load(tmp_path)
    assert p.recording("rec_02")["transcript_id"] == "tr_01" and p.manifest["transcripts"][0]["bytes"] == 3
    assert (p.config.sample_fps, p.config.cut_distance, p.manifest["project"]) == (2.0, 0.3, "demo")
    p.manifest["states"] = [{"id": "state_0001", "kind": "screen", "occurrences": [{"recording_id": r, "start_tc": t} for r, t in (("rec_01", "00:00:09"), ("rec_02", "00:00:04"), ("rec_02", "00:00:05"))]}]
    assert p.listing()["states"] == [["state_0001", "screen", "3", "2", "00:00:04"]]
    capsys.readouterr()
    assert main(["list"]) == 0 and main(["inspect", "nothing"]) == 1
    assert "  tr_01  note.md  md  rec_02" in capsys.readouterr().out
    assert main(["status"]) == 0
    assert "to be built: one.mp4, two.mp4" in capsys.readouterr().out
    assert main(["inspect", "two.mp4"]) == 0
    assert "recording rec_02: two.mp4, added\n0.0s, 0x0, 0 fps, -, transcript tr_01" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        main(["--version"])
    assert e.value.code == 0
    assert p.status()["pending"] == "one.mp4, two.mp4"


def test_id_wins_over_file_name(tmp_path):
    p = Project.create(tmp_path, "demo")
    for n in ("rec_02.mp4", "b.mp4"):
        (tmp_path / n).write_text("")
        p.add(tmp_path / n)
    p.manifest["recordings"][0]["filename"] = "rec_02"
    assert p.recording("rec_02")["id"] == "rec_02"
    p.manifest["transcripts"].append({"id": "tr_01", "oops": 1})
    p.save()
    with pytest.raises(ProjectError):
        Project.load(tmp_path)


def shown(p, rec, pictures):
    folder = p.frames_root() / f"recording_id={rec}"
    folder.mkdir(parents=True)
    for k, picture in enumerate(pictures):
        (folder / f"frame_{k + 1:06d}.png").write_bytes(png_bytes(picture))


def project_of(root, plans):
    p = Project.create(root, "demo")
    for k, (rec, pictures) in enumerate(plans.items()):
        (root / f"{k}.mp4").write_bytes(b"x")
        assert p.add(root / f"{k}.mp4")["id"] == rec
        shown(p, rec, pictures)
    return p


def test_kinds_come_from_representative_frames(tmp_path, spark):
    """The last frame of the first screen is dark; its representative isn't, so the way to the next screen is no modal."""
    a, b = screen(1), screen(2)
    dark = (a * 0.6).astype(np.uint8)
    p = project_of(tmp_path, {"rec_01": [a] * 5 + [dark] + [b] * 3})
    p.build(spark)
    frames = p.table(spark, "labelled").orderBy("seg_no").collect()
    assert frames[0]["end_idx"] == 5 and frames[0]["rep_idx"] < 5
    (t,) = p.manifest["transitions"]
    from tideframe.operators.states import boundary_kind
    from pyspark.sql import functions as F

    want = spark.range(1).select(boundary_kind(*[F.lit(x) for x in images.boundary_metrics(a, b)]).alias("k")).first()["k"]
    assert (t["kind"], t["confidence"]) == tuple(want)


def test_a_failing_embedder_stops_its_recording_only(tmp_path, spark):
    class Picky:
        """A plug-in that fails on frames whose first pixel is pure red."""

        name = "picky"

        def embed(self, bgr):
            if tuple(bgr[0, 0]) == (0, 0, 255):
                raise KeyError("red")
            return images.DefaultEmbedder().embed(bgr)

    images.register_embedder("picky", Picky)
    red = screen(3)
    red[0, 0] = (0, 0, 255)
    p = project_of(tmp_path, {"rec_01": [screen(1)] * 3, "rec_02": [screen(1), red, screen(2)], "rec_03": [screen(2)] * 2})
    (p.frames_root() / "recording_id=rec_03" / "frame_000002.png").write_bytes(b"broken")
    report = p.build(spark, config=p.config.with_flags(embedder="picky"))
    assert [r["error"] for r in p.manifest["recordings"]] == [None, "KeyError: 'red'", "a frame can't be read"]
    assert [r["status"] for r in p.manifest["recordings"]] == ["processed", "error", "error"] and len(report["warnings"]) == 2
    assert report["totals"]["recordings_processed"] == 1


def test_errors_stay_beside_results():
    assert images._said(KeyError("red")) == "KeyError: 'red'"


def test_a_scroll_run_is_stitched(tmp_path, spark):
    rng = np.random.default_rng(9)
    page = np.repeat(np.kron(rng.integers(0, 256, (90, 40), dtype=np.uint8), np.ones((8, 8), np.uint8))[:, :, None], 3, axis=2)
    p = project_of(tmp_path, {"rec_01": [page[k * 56 : k * 56 + H] for k in range(6)]})
    report = p.build(spark)
    assert report["totals"]["scroll_states"] == 1 and report["kinds"]["states"] == {"scroll": 1}
    assert images.read_png(f"{tmp_path}/.tideframe/stitched/state_0001.png").shape[0] == H + 5 * 56


FAKE = """#!/bin/sh
{body}
"""


def test_tools_on_the_path(tmp_path, spark, monkeypatch):
    """Probing and sampling with stand-ins for the two programs, and the one-video command."""
    tools = tmp_path / "bin"
    tools.mkdir()
    frame = tmp_path / "frame.png"
    frame.write_bytes(png_bytes(screen(1)))
    probe = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "r_frame_rate": "60/1", "avg_frame_rate": "11/2", "width": W, "height": H, "codec_name": "h264"}], "format": {"duration": "3.5"}}
    (tools / "ffprobe").write_text(FAKE.format(body=f"case \"$*\" in *bad*) echo broken >&2; exit 1;; esac\ncat <<'X'\n{json.dumps(probe)}\nX"))
    (tools / "ffmpeg").write_text(FAKE.format(body=f'for last; do :; done\nd=$(dirname "$last")\nfor k in 1 2 3; do cp {frame} "$d/frame_00000$k.png"; done'))
    for t in tools.iterdir():
        t.chmod(0o755)
    for rec in ("ok", "bad"):
        (tmp_path / f"{rec}.mp4").write_bytes(b"x")
    videos = spark.createDataFrame([("r1", str(tmp_path / "ok.mp4")), ("r2", str(tmp_path / "bad.mp4"))], "recording_id string, path string")
    path = f"{tools}:{os.environ['PATH']}"
    # workers that run already have the old path, so the programs are called from here through the same functions
    monkeypatch.setenv("PATH", path)
    sources.ensure_tools()
    assert sources.parse_probe(json.dumps(probe)) == (3.5, 60.0, W, H, "h264")
    assert sources.parse_probe("") == (0.0, 0.0, 0, 0, "") and sources.parse_probe('{"streams": [{"codec_type": "video", "r_frame_rate": "0/0"}]}')[1] == 0.0
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(sources.ToolError):
        sources.ensure_tools()
    found = {r["path"].rsplit("/", 1)[1]: r for r in sources.probe_videos(videos).collect()}
    assert set(found) == {"ok.mp4", "bad.mp4"} and all((r["metadata"] is None) == (r["error"] is not None) for r in found.values())


def test_analyze_makes_a_folder_of_its_own(tmp_path, spark, monkeypatch):
    outer = Project.create(tmp_path, "outer")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "talk.mp4").write_bytes(b"x")
    with pytest.raises(ProjectError):  # without tools there are no frames
        analyze(spark, tmp_path / "talk.mp4")
    inner = Project.load(tmp_path / "talk_tideframe")
    assert inner.manifest["project"] == "talk" and [r["filename"] for r in inner.manifest["recordings"]] == ["talk.mp4"]
    assert inner.manifest["recordings"][0]["status"] == "error" and Project.load(tmp_path).manifest["recordings"] == outer.manifest["recordings"] == []
    shown(inner, "rec_01", [screen(1)] * 3)
    assert analyze(spark, tmp_path / "talk.mp4")["totals"]["states"] == 1


def test_analyze_lays_flags_over_the_stored_configuration(tmp_path, spark, monkeypatch, capsys):
    p = Project.create(tmp_path / "talk_tideframe", "talk", Config(cut_distance=0.33, merge_distance=0.2))
    (tmp_path / "talk.mp4").write_bytes(b"x")
    shown(p, "rec_01", [screen(1)] * 2 + [screen(2)] * 2)
    monkeypatch.chdir(tmp_path)
    analyze(spark, tmp_path / "talk.mp4")
    assert Project.load(p.root).config == Config(cut_distance=0.33, merge_distance=0.2)
    capsys.readouterr()
    assert main(["analyze", "talk.mp4", "--fps", "1.0", "--cut-distance", "0.3"]) == 0
    assert Project.load(p.root).config == Config(cut_distance=0.3, merge_distance=0.2)
    said = capsys.readouterr()
    assert "states found" in said.err and '"states": 2' in said.out and "built in" in said.out


def test_a_failed_probe_is_told(tmp_path, spark, monkeypatch, capsys):
    """A broken recording isn't built from frames that happen to be there; a missing tool is no fault of the recording."""
    from pyspark.sql import functions as F

    p = Project.create(tmp_path, "demo")
    for n in ("ok.mp4", "broken.mp4"):
        (tmp_path / n).write_bytes(b"x")
        p.add(tmp_path / n)
    for rec in ("rec_01", "rec_02"):
        shown(p, rec, [screen(1)] * 2)

    def probe(paths):
        text = F.when(F.col("path").endswith("broken.mp4"), F.lit("moov atom not found")).otherwise(F.lit(f"{sources.MISSING}: ffprobe"))
        return paths.select("path", F.lit(None).cast("struct<duration:double,fps:double,width:int,height:int,codec:string>").alias("metadata"), text.alias("error"))

    monkeypatch.setattr(sources, "probe_videos", probe)
    monkeypatch.chdir(tmp_path)
    assert main(["build"]) == 0
    assert "warning: rec_02: moov atom not found" in capsys.readouterr().err
    assert [(r["status"], r["error"]) for r in Project.load(tmp_path).manifest["recordings"]] == [("processed", None), ("error", "moov atom not found")]


def test_many_files_at_once(tmp_path, spark):
    p = Project.create(tmp_path, "demo")
    for n in ("b.mp4", "a.MOV", "note.md", "x.xyz", "talk.vtt"):
        (tmp_path / n).write_text(n)
    p.add(tmp_path / "b.mp4")
    assert p.add_all(spark, tmp_path) == ["rec_02", "tr_01", "tr_02"]
    again = Project.load(tmp_path)
    assert [r["filename"] for r in again.manifest["recordings"]] == ["b.mp4", "a.MOV"] and [t["bytes"] for t in again.manifest["transcripts"]] == [7, 8]
    assert p.add_all(spark, tmp_path / ".tideframe" / "cache" if (tmp_path / ".tideframe" / "cache").exists() else tmp_path)[:1] != ["rec_03"]


def test_a_build_that_dies_leaves_the_last_one(tmp_path, spark, monkeypatch):
    """Tables, pictures and the manifest of the last whole build stay readable wherever the next one stops."""
    from tideframe.plans import views
    from tideframe.operators import segments, states
    from tideframe.sources.pictures import Pictures

    p = project_of(tmp_path, {"rec_01": [screen(1)] * 3 + [screen(2)] * 3})
    with pytest.raises(ProjectError):
        p.table(spark, "segments")
    p.build(spark)

    def state():
        now, shots = Project.load(tmp_path), tmp_path / ".tideframe" / "screenshots"
        return now.table(spark, "segments").count(), [s["id"] for s in now.manifest["states"]], {f.name: f.read_bytes() for f in shots.iterdir() if f.is_file()}

    before = state()
    assert before[:2] == (2, ["state_0001", "state_0002"]) and len(before[2]) == 2
    shown(p, "rec_02", [screen(3)] * 3)
    (tmp_path / "1.mp4").write_bytes(b"x")
    p.add(tmp_path / "1.mp4")
    for module, name in ((segments, "segment_recordings"), (states, "labelled_segments"), (states, "transitions"), (views, "build_report")):
        with monkeypatch.context() as m:
            m.setattr(module, name, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                Project.load(tmp_path).build(spark)
        assert state() == before
    Project.load(tmp_path).build(spark)
    after = state()
    assert after[:2] == (3, ["state_0001", "state_0002", "state_0003"]) and len(after[2]) == 3
    assert len(list((tmp_path / ".tideframe" / "cache" / "tables").iterdir())) == 1
    assert not (tmp_path / ".tideframe" / "screenshots" / "_staging").exists()


def test_a_task_that_fails_once_leaves_one_picture(tmp_path):
    """Attempts are told apart; only what is committed comes into place."""
    from tideframe.sources.pictures import Pictures, PictureWriter

    options = {"path": str(tmp_path / "shots"), "job": "j"}

    def broken():
        yield "a.png", None, b"half"
        raise OSError("lost")

    with pytest.raises(OSError):
        PictureWriter(options).write(broken())
    first = PictureWriter(options).write(iter([("a.png", None, b"whole"), ("c.png", None, None)]))
    PictureWriter(options).write(iter([("a.png", None, b"a copy that is not used")]))
    (tmp_path / "of").write_bytes(b"copied")
    second = PictureWriter(options).write(iter([("b.png", str(tmp_path / "of"), None)]))
    writer = PictureWriter(options)
    writer.commit([first, second, None])
    (tmp_path / "shots" / "old.png").write_bytes(b"old")
    pictures = Pictures.__new__(Pictures)
    pictures._folder, pictures._job = options["path"], "j"
    pictures.promote()
    assert {f.name: f.read_bytes() for f in (tmp_path / "shots").iterdir()} == {"a.png": b"whole", "b.png": b"copied"}
    third = PictureWriter(options)
    third.abort([third.write(iter([("d.png", None, b"d")]))])
    assert {f.name for f in (tmp_path / "shots").rglob("*.png")} == {"a.png", "b.png"}
