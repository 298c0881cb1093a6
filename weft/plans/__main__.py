"""Statistics and plans from the command line, over a graph that `files.write_graph` wrote.

    python -m weft.plans tables GRAPH                       rows of every label and relation
    python -m weft.plans patterns GRAPH --most 3            patterns that the schema allows, one JSON object a line
    python -m weft.plans catalogue GRAPH OUT --most 3       count them, or those of --patterns FILE, level by level; --limit bounds the samples
    python -m weft.plans ceg CATALOGUE GRAPH PATTERN        the ways to estimate a pattern: each edge taken away, and what follows
    python -m weft.plans plan CATALOGUE GRAPH PATTERN       the cheapest plan; --space extend, join or hybrid
    python -m weft.plans count GRAPH PATTERN                the pattern's bindings, counted

A pattern is a JSON file, or lines of such objects for --patterns.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.files import read_graph
from .catalogue import Catalogue, aggregated, counted
from .pattern import Pattern, patterns_of
from .pattern_planner import PatternPlanner, query_graph
from .render import rendered


def ways(catalogue: Catalogue, pattern: Pattern) -> list[tuple[str, float]]:
    """Estimates of a pattern by the edge that is taken away first."""
    out = []
    for e in pattern.edges:
        value = catalogue._removed(pattern, e, catalogue.estimate)
        if value is not None:
            out.append((f"{e.src}-[{e.relation}]->{e.dst}", value))
    return out


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Lines of output."""
    parser = argparse.ArgumentParser(prog="weft.plans", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    wants = {"tables": ["graph"], "patterns": ["graph"], "catalogue": ["graph", "out"], "ceg": ["catalogue", "graph", "pattern"], "plan": ["catalogue", "graph", "pattern"], "count": ["graph", "pattern"]}
    for name, own in wants.items():
        sub = commands.add_parser(name)
        for x in own:
            sub.add_argument(x)
        sub.add_argument("--most", type=int, default=2)
        sub.add_argument("--limit", type=int, default=100_000)
        sub.add_argument("--rate", type=float, default=1.0)
        sub.add_argument("--patterns")
        sub.add_argument("--space", default="hybrid")
    args = parser.parse_args(argv)
    graph = read_graph(spark, args.graph)
    if args.command == "tables":
        return [f"{r.kind}\t{'-'.join(x for x in (r.src_label, r.label, r.dst_label) if x)}\t{r.rows}" for r in aggregated(graph).collect()]
    if args.command == "patterns":
        return [json.dumps(p.to_json(graph.schema)) for p in patterns_of(graph.schema, args.most)]
    if args.command == "catalogue":
        lines = Path(args.patterns).read_text().splitlines() if args.patterns else []
        wanted = [Pattern.from_json(json.loads(x), graph.schema) for x in lines if x.strip()] or patterns_of(graph.schema, args.most)
        found = Catalogue.levelled(graph, wanted, args.most, args.rate, args.limit)
        found.save(spark, args.out)
        return found.printed().splitlines()
    pattern = Pattern.from_json(json.loads(Path(args.pattern).read_text()), graph.schema).validated(graph.schema)
    if args.command == "count":
        return [f"{counted(graph, pattern):.0f}"]
    catalogue = Catalogue.load(spark, args.catalogue)
    if args.command == "ceg":
        return [f"{v:.6g}\tless {e}" for e, v in ways(catalogue, pattern)] + [f"{catalogue.estimate(pattern):.6g}\testimate"]
    return rendered(PatternPlanner(pattern, catalogue, args.space).best(), query_graph(pattern)).splitlines()


if __name__ == "__main__":
    import sys

    print(*run(SparkSession.builder.getOrCreate(), sys.argv[1:]), sep="\n")
