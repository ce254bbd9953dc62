"""Command line: init, add, build, status, list, inspect, export, analyze."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .config import Config
from .functions.text import STATUS_COLOURS
from .project import Project, ProjectError, analyze


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tideframe")
    parser.add_argument("--version", action="version", version=f"tideframe {__version__}")
    sub = parser.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("name", help="folder to create")
    add = sub.add_parser("add")
    add.add_argument("file")
    add.add_argument("--for", dest="recording_for")
    for name in ("init", "build", "analyze"):
        p = init if name == "init" else sub.add_parser(name)
        p.add_argument("--fps", type=float)
        p.add_argument("--embedder")
        p.add_argument("--cut-distance", type=float)
        if name == "build":
            p.add_argument("--force", action="store_true")
        elif name == "analyze":
            p.add_argument("video")
            p.add_argument("-o", "--output", dest="out", help="project folder; NAME_tideframe for a video called NAME")
    for name in ("status", "list", "export"):
        sub.add_parser(name)
    sub.add_parser("inspect").add_argument("target", nargs="?")
    return parser


def _flags(args) -> dict:
    return {"sample_fps": args.fps, "embedder": args.embedder, "cut_distance": args.cut_distance}


def _list(project: Project) -> None:
    for title, rows in project.listing().items():
        print(title)
        _table(rows)


def _table(rows: list[list[str]]) -> None:
    """Rows with their columns below each other."""
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    for row in rows:
        print("  " + "  ".join(_coloured(x) + " " * (w - len(x)) for x, w in zip(row, widths, strict=True)).rstrip())


def _status(project: Project) -> None:
    s = project.status()
    print(f"{s['project']}: {s['recordings']} recordings, {s['transcripts']} transcripts")
    print(f"{s['states']} states, {s['scroll_states']} of them scrolls, {s['transitions']} transitions")
    print(f"to be built: {s['pending']}" if s["pending"] else "all recordings are built")


def _inspect(project: Project, target: str) -> None:
    kind, found = project.inspect(target)
    if kind == "state":
        print(f"state {found['id']} ({found['kind']}), {found['representative_screenshot']}")
        if found["stitched_screenshot"]:
            print(f"stitched: {found['stitched_screenshot']}")
        _table([[o["recording_id"], o["start_tc"], o["end_tc"], f"{o['confidence']:.2f}"] for o in found["occurrences"]])
        return
    m = found["metadata"]
    print(f"recording {found['id']}: {found['filename']}, {_coloured(found['status'])}" + (f" ({found['error']})" if found["error"] else ""))
    print(f"{m['duration']:.1f}s, {m['width']}x{m['height']}, {m['fps']:g} fps, {m['codec'] or '-'}, transcript {found['transcript_id'] or '-'}")
    _table([[t["id"], t["at_tc"], f"{t['from_state']} -> {t['to_state']}", t["kind"], f"{t['confidence']:.2f}"] for t in found["transitions"]])


def _built(report: dict) -> None:
    for warning in report["warnings"]:
        print(f"warning: {warning}", file=sys.stderr)
    print(json.dumps(report["totals"], indent=2))
    print(f"built in {report['elapsed_seconds']:.1f}s")


def _log(line: str) -> None:
    print(line, file=sys.stderr)


def _coloured(status: str) -> str:
    """A status in its colour, where someone looks at it; anything else as it is."""
    return f"\x1b[{STATUS_COLOURS[status]}m{status}\x1b[0m" if status in STATUS_COLOURS and sys.stdout.isatty() else status


def run(argv: list[str]) -> None:
    args = _parser().parse_args(argv)
    session = lambda: SparkSession.builder.appName("tideframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "init":
        root = Path(args.name).resolve()
        Project.create(root, root.name, Config().with_flags(**_flags(args)))
        print(root)
    elif args.command == "analyze":
        _built(analyze(session(), args.video, args.out, _flags(args), _log))
    else:
        project = Project.load(".")
        if args.command == "add":
            print(project.add(args.file, args.recording_for)["id"])
        elif args.command == "build":
            _built(project.build(session(), args.force, project.config.with_flags(**_flags(args)), _log))
        elif args.command == "status":
            _status(project)
        elif args.command == "export":
            print(project.export(session()))
        elif args.command == "inspect" and args.target:
            _inspect(project, args.target)
        else:
            _list(project)


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, 1 for a project's or a file's error, 130 when interrupted."""
    try:
        run(sys.argv[1:] if argv is None else argv)
    except (ProjectError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
