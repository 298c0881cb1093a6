"""Lowering of plans to DataFrames, in the chosen order; Catalyst does the rest.

Columns of the result are `<alias>__<column>`. Every alias has `__id` if it is in the graph. Closing edges are joined at once: as inner joins, which keep the
multiplicity of parallel edges, or as semi-joins on distinct edges with `distinct`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Compiler
from ..sources.graph import PropertyGraph
from .pattern import PatternError
from .planner import Link, Plan, QueryGraph


class Lowering:
    def __init__(self, graph: PropertyGraph, query: QueryGraph, columns: dict[str, list[str]] | None = None, tables: dict[str, DataFrame] | None = None, distinct: bool = False, filters: dict[str, str] | None = None, conditions: list[tuple[str, str, Column]] | None = None):
        """`columns`: what is wanted of each alias (vertices: properties; named edges: their columns). `tables` has plain tables by name. `filters` are infix predicates on
        single vertices, which go to their scans; `conditions` hold between two aliases and are applied as soon as both are bound.

        A vertex table is joined only for its predicate or columns: edges already imply labels.
        """
        self.graph, self.query, self.columns, self.tables, self.distinct = graph, query, columns or {}, tables or {}, distinct
        self.filters, self.conditions = filters or {}, conditions or []

    def vertex(self, alias: str) -> DataFrame:
        v = self.query.vertices[alias]
        if v.label is None:
            df = self.tables[v.table or alias]
            df = df.where(F.expr(v.predicate)) if v.predicate else df
            wanted = df.columns
        else:
            df = self.graph.vertices(v.label, predicate=None)
            df = df.where(F.expr(v.predicate)) if v.predicate else df
            if alias in self.filters:
                df = df.where(Compiler(df, lambda _, prop: F.col((prop or "id").lstrip("~"))).predicate(self.filters[alias]))
            wanted = ["id", *[c for c in self.columns.get(alias, []) if c != "id"]]
        return df.select(*[F.col(c).alias(f"{alias}__{c}") for c in wanted])

    def needed(self, alias: str) -> bool:
        v = self.query.vertices[alias]
        return v.label is None or bool(v.predicate) or alias in self.filters or bool([c for c in self.columns.get(alias, []) if c != "id"])

    def edge(self, link: Link) -> DataFrame:
        """_s, _d and the named columns of a relation's edges."""
        q = self.query.vertices
        e = self.graph.edges([link.relation], [q[link.src].label], [q[link.dst].label])
        e = e.where(F.expr(link.predicate)) if link.predicate else e
        wanted = [F.col(c).alias(f"{link.alias}__{c}") for c in self.columns.get(link.alias, [])] if link.alias else []
        out = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *wanted)
        out = out.distinct() if self.distinct and not wanted else out
        return F.broadcast(out) if not wanted and set(self.graph.schema.matching([link.relation], [q[link.src].label], [q[link.dst].label])) <= self.graph.small else out

    def condition(self, link: Link) -> Column:
        if link.identity:
            return F.col(f"{link.src}__id") == F.col(f"{link.dst}__id")
        return reduce(lambda a, b: a & b, [F.col(f"{link.src}__{a}") == F.col(f"{link.dst}__{b}") for a, b in link.on])

    def closed(self, df: DataFrame, link: Link) -> DataFrame:
        if not link.relation or link.identity:
            return df.where(self.condition(link))
        e = self.edge(link)
        kind = "left_semi" if self.distinct and len(e.columns) == 2 else "inner"
        out = df.join(e, (F.col(f"{link.src}__id") == F.col("_s")) & (F.col(f"{link.dst}__id") == F.col("_d")), kind)
        return out.drop("_s", "_d")

    def lowered(self, plan: Plan) -> DataFrame:
        df = self.bindings(plan)
        for a, b, condition in self.conditions:
            if {a, b} <= plan.covered and not any({a, b} <= p.covered for p in plan.inputs):
                df = df.where(condition)
        return df

    def bindings(self, plan: Plan) -> DataFrame:
        if plan.kind in ("scan", "get"):
            return self.vertex(plan.alias)
        if plan.kind == "merge":
            left, right = (self.lowered(p) for p in plan.inputs)
            return self.merged(left, right, plan)
        if plan.kind == "overlap":
            left, right = (self.lowered(p) for p in plan.inputs)
            keys = [f"{a}__id" for a in sorted(plan.inputs[0].covered & plan.inputs[1].covered)]
            twice = [c for c in right.columns if c in left.columns and c not in keys]
            return left.join(right.drop(*twice), keys)
        alias, main, before = plan.alias, plan.links[0], plan.inputs[0]
        if main.relation and not main.identity and before.kind == "scan" and not self.needed(before.alias) and not self.needed(alias):
            # The edges have both ends: no vertex table is read
            df = self.edge(main).withColumnsRenamed({"_s": f"{main.src}__id", "_d": f"{main.dst}__id"})
            return reduce(self.closed, plan.links[1:], df)
        df = self.lowered(before)
        if main.identity or not main.relation:
            df = df.join(self.vertex(alias), self.condition(main))
        else:
            known, new = ("_s", "_d") if main.dst == alias else ("_d", "_s")
            other = main.src if main.dst == alias else main.dst
            df = df.join(self.edge(main), F.col(f"{other}__id") == F.col(known)).withColumnRenamed(new, f"{alias}__id").drop(known)
            if self.needed(alias):
                right = self.vertex(alias).withColumnRenamed(f"{alias}__id", "_v")
                df = df.join(right, F.col(f"{alias}__id") == F.col("_v")).drop("_v")
        return reduce(self.closed, plan.links[1:], df)

    def merged(self, left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
        if not plan.links:
            return left.crossJoin(right)
        # The first crossing edge joins the sides; the others are closed on the result.
        plain = [k for k in plan.links if k.identity or not k.relation]
        main = plain[0] if plain else plan.links[0]
        rest = [k for k in plan.links if k is not main]
        if plain:
            out = left.join(right, self.condition(main))
        else:
            first = main.src if main.src in plan.inputs[0].covered else main.dst
            known, new = ("_s", "_d") if first == main.src else ("_d", "_s")
            other = main.dst if first == main.src else main.src
            out = left.join(self.edge(main), F.col(f"{first}__id") == F.col(known)).join(right, F.col(new) == F.col(f"{other}__id")).drop("_s", "_d")
        return reduce(self.closed, rest, out)


def executed(plan: Plan, graph: PropertyGraph, query: QueryGraph, columns: dict[str, list[str]] | None = None, tables: dict[str, DataFrame] | None = None, distinct: bool = False, **options) -> DataFrame:
    """All bindings of the query graph by the plan."""
    if plan.covered != frozenset(query.vertices):
        raise PatternError("the plan does not cover the query")
    return Lowering(graph, query, columns, tables, distinct, **options).lowered(plan)
