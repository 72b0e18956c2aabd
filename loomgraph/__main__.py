"""Command line: build a graph, and put questions to a stored one."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from loomgraph.operators import traverse
from loomgraph.plans.build import build
from loomgraph.plans.stored import StoredGraph
from loomgraph.session import build_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description="Property-graph analytics on Spark")
    p.add_argument("--graph", default="loomgraph-out", help="folder of the stored graph")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--rows", type=int, default=50, help="rows printed of an answer")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("root")
    for flag in ("--update", "--directed", "--no-report"):
        b.add_argument(flag, action="store_true")
    b.add_argument("--resolution", type=float, default=1.0)
    b.add_argument("--exclude", action="append")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--budget", type=int, default=60)
    h = sub.add_parser("path")
    h.add_argument("a")
    h.add_argument("b")
    h.add_argument("--max-hops", type=int, default=6)
    for command in ("explain", "neighbors"):
        sub.add_parser(command).add_argument("name")
    a = sub.add_parser("affected")
    a.add_argument("name")
    a.add_argument("--depth", type=int, default=4)
    return p


def _show(answer: DataFrame | None, rows: int) -> int:
    if answer is None or answer.isEmpty():
        print("nothing found")
        return 1
    answer.show(rows, truncate=False)
    return 0


def run(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session(args.master)
    if args.command == "build":
        done = build(
            spark, args.root, args.graph, update=args.update, directed=args.directed,
            write_report=not args.no_report, resolution=args.resolution, extra_excludes=args.exclude,
        )
        print(f"nodes {done.nodes}, edges {done.edges}, communities {done.communities}; files read {done.extracted_files}, unchanged {done.cached_files}")
        return 0
    try:
        g = StoredGraph.open(spark, args.graph)
    except AnalysisException:
        print(f"{args.graph} holds no graph; build one first", file=sys.stderr)
        return 1
    if args.command == "query":
        return _show(g.hits(args.question, args.budget), args.rows)
    if args.command == "path":
        return _show(g.route(args.a, args.b, args.max_hops), args.rows)
    if args.command == "affected":
        return _show(g.downstream(args.name, args.depth), args.rows)
    if args.command == "neighbors":
        return _show(g.around(args.name), args.rows)
    found = traverse.explain(g.nodes, g.edges, args.name, g.communities)
    if found is None:
        return _show(None, args.rows)
    for key, value in found.items():
        for line in value if isinstance(value, list) else [value]:
            print(f"{key}: {line}")
    return 0


if __name__ == "__main__":
    sys.exit(run())
