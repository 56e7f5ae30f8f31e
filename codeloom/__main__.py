"""Command line: python -m codeloom scan|sync|init|query|path|serve"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from codeloom import config as settings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--out", default=".codeloom")
    scan.add_argument("--list-only", action="store_true")
    scan.add_argument("--doc-references", action="store_true")
    sync = commands.add_parser("sync")
    sync.add_argument("--config")
    commands.add_parser("init").add_argument("path", nargs="?", default=".")
    for name, words in (("query", ["term"]), ("path", ["source", "target"]), ("serve", [])):
        one = commands.add_parser(name)
        for word in words:
            one.add_argument(word)
        one.add_argument("--dir", default=".codeloom")
    args = parser.parse_args(argv)
    if args.command in ("init", "scan") and (args.command == "init" or args.list_only):
        from codeloom.sources.scan import discover

        found = [p for root in ([args.path] if args.command == "init" else args.paths) for p in discover(root)]
        if args.command == "init":
            settings.write(Path(args.path) / settings.FILE, [settings.Project(p.name, str(p)) for p in found])
        print(*found, sep="\n")
        return 0
    from codeloom.engine import Engine
    from codeloom.session import local_session

    spark = local_session()
    if args.command == "scan":
        Path(args.out).mkdir(parents=True, exist_ok=True)
        Engine.scan(spark, *args.paths, doc_references=args.doc_references).save(str(Path(args.out).resolve()))
        return 0
    if args.command == "sync":
        path = args.config or settings.find(".")
        if path is None:
            print(f"no {settings.FILE} here or above", file=sys.stderr)
            return 1
        engine = Engine.from_config(spark, str(path))
        Path(engine.config.output).mkdir(parents=True, exist_ok=True)
        engine.save(engine.config.output)
        return 0
    engine = Engine.load(spark, f"{Path(args.dir).resolve()}/graph")
    if args.command == "query":
        engine.search(args.term).show(100, truncate=False)
    elif args.command == "path":
        engine.path(args.source, args.target).orderBy("place").show(100, truncate=False)
    else:
        from codeloom.server import Server

        Server(engine, f"{args.dir}/wiki").run(sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
