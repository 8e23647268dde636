"""Command line: index a repository and ask about it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import __version__
from .api import CodeIndex


def session() -> SparkSession:
    return SparkSession.builder.appName("codelattice").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codelattice", description=__doc__)
    p.add_argument("--index", default=".codelattice", help="folder of the index")
    p.add_argument("--root", default=".", help="the repository")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    s = sub.add_parser("symbol")
    s.add_argument("name")
    s.add_argument("--refs", action="store_true")
    for name in ("info", "serve", "version"):
        sub.add_parser(name)
    for name in ("search", "outline", "impact"):
        sub.add_parser(name).add_argument("what")
    sub.add_parser("deps").add_argument("what", nargs="?")
    sub.add_parser("hotspots").add_argument("what", nargs="?")
    args = p.parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    code = CodeIndex(session(), args.index, args.root)
    if args.command == "index":
        print(", ".join(f"{n} {a}" for a, n in sorted(code.refresh().items())))
        return 0
    if args.command == "serve":
        from .serve import Server

        Server(code).serve()
        return 0
    calls = {
        "info": lambda: code.repo_summary(), "search": lambda: code.search_symbols(args.what), "outline": lambda: code.file_outline(args.what), "impact": lambda: code.diff_impact(args.what),
        "deps": lambda: code.module_dependencies(args.what), "hotspots": lambda: code.hotspots(args.what),
        "symbol": lambda: code.find_references(args.name) if args.refs else code.symbol_or_words(args.name),
    }
    print(calls[args.command]())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
