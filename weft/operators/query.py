"""Fluent queries over a property graph and plain tables.

A query is a DataFrame plus what its tags stand for. A vertex tag `a` has columns `a__id` and `a__label` and the properties fetched so far; an
edge tag has `__src`, `__dst`, their labels and properties; a path tag has `__path` (array of ids), `__end`, `__label` (of the end) and `__len`; any other tag is one column named
as it is. Properties are joined when an expression first asks for them, so columns nobody uses are never read. The head is the last tag introduced.

All operators are lazy compositions of DataFrame operators; Catalyst picks the join strategies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.expr import Compiler, parse, variables
from ..sources.graph import PropertyGraph

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "times": "cross"}


class QueryError(ValueError):
    """The query asks for a tag, property or combination that does not exist."""


class GraphQuery:
    def __init__(self, graph: PropertyGraph, df: DataFrame | None = None, tags: dict[str, tuple] | None = None, head: str | None = None):
        """`tags`: name -> ("vertex", labels) | ("edge", relations) | ("path", labels) | ("value",)."""
        self.graph, self.df, self.tags, self.head = graph, df, dict(tags or {}), head
        #: Counts the rows without making them, right after a MATCH that allows it.
        self.counter: Callable[[], DataFrame] | None = None

    def _with(self, df: DataFrame, tags: dict | None = None, head: str | None = "") -> GraphQuery:
        return GraphQuery(self.graph, df, self.tags if tags is None else tags, self.head if head == "" else head)

    def _fresh(self, alias: str | None) -> str:
        if alias is None:
            k = 0
            while f"_{k}" in self.tags:
                k += 1
            return f"_{k}"
        if alias in self.tags:
            raise QueryError(f"tag {alias!r} exists")
        return alias

    # --- names ------------------------------------------------------------------------------------------------------

    def _tag(self, tag: str | None) -> str:
        name = self.head if tag is None else tag
        if name not in self.tags:
            raise QueryError(f"no tag {name!r}")
        return name

    def column(self, tag: str | None, prop: str | None) -> Column:
        """Column of a tag, or of its property, which must have been fetched."""
        name = self._tag(tag)
        kind = self.tags[name][0]
        if kind == "value":
            if prop:
                raise QueryError(f"{name} has no properties")
            return F.col(f"`{name}`")
        key = {"vertex": "id", "edge": "src", "path": "path"}[kind] if prop is None else prop
        if key == "~all":
            own = [c for c in self.df.columns if c.startswith(f"{name}__")]
            return F.struct(*[F.col(c).alias(c[len(name) + 2 :]) for c in own])
        if kind == "path" and key in ("~id", "id"):
            key = "end"
        return F.col(f"`{name}__{key.lstrip('~')}`")

    def fetch(self, tag: str | None, *columns: str) -> GraphQuery:
        """Join properties of a vertex tag (or of a path's end) that are not there yet."""
        name = self._tag(tag)
        kind = self.tags[name][0]
        missing = [c for c in dict.fromkeys(columns) if f"{name}__{c}" not in self.df.columns]
        if not missing:
            return self
        if kind not in ("vertex", "path"):
            raise QueryError(f"{name} has no property {missing[0]!r}")
        labels = self.tags[name][1]
        if bad := set(missing) - set(self.graph.columns_of(labels)):
            raise QueryError(f"{sorted(labels)} have no property {sorted(bad)[0]!r}")
        key = "id" if kind == "vertex" else "end"
        table = self.graph.vertices(labels, missing).select(F.col("id").alias("_i"), F.col("label").alias("_l"), *[F.col(c).alias(f"{name}__{c}") for c in missing])
        on = F.col(f"{name}__{key}") == F.col("_i")
        if len(labels) > 1:
            on = on & (F.col(f"{name}__label") == F.col("_l"))
        return self._with(self.df.join(table, on, "left").drop("_i", "_l"))

    def _prepared(self, *texts: str | Column) -> GraphQuery:
        """With every property fetched that the expressions use."""
        out = self
        for text in texts:
            for tag, prop in sorted(variables(parse(text)), key=str) if isinstance(text, str) else ():
                name = out._tag(tag)
                if prop == "~all" and out.tags[name][0] == "vertex":
                    out = out.fetch(name, *out.graph.columns_of(out.tags[name][1]))
                elif prop and not prop.startswith("~") and out.tags[name][0] != "value":
                    out = out.fetch(name, prop) if out.tags[name][0] != "edge" else out
        return out

    def _value(self, text: str | Column) -> Column:
        return text if isinstance(text, Column) else Compiler(self.df, self.column).projection(text)

    # --- sources ----------------------------------------------------------------------------------------------------

    def scan(self, labels=None, alias: str | None = None, predicate: str | None = None, ids=None, sample: float | None = None, seed: int | None = None, limit: int | None = None) -> GraphQuery:
        """Vertices; all labels if none is given."""
        name = self._fresh(alias)
        names = self.graph.labels_of(labels)
        df = self.graph.vertices(names, None, predicate, ids, sample, seed, limit)
        df = df.select(*[F.col(c).alias(f"{name}__{c}") for c in df.columns])
        return GraphQuery(self.graph, df, {name: ("vertex", tuple(names))}, name)

    def scan_edges(self, relations=None, alias: str | None = None, predicate: str | None = None, **options) -> GraphQuery:
        name = self._fresh(alias)
        df = self.graph.edges(relations, predicate=predicate, **options)
        df = df.select(*[F.col(c).alias(f"{name}__{c}") for c in df.columns])
        return GraphQuery(self.graph, df, {name: ("edge", tuple(self.graph.schema.matching(relations)))}, name)

    def scan_table(self, df: DataFrame) -> GraphQuery:
        """A plain table; every column is a tag."""
        return GraphQuery(self.graph, df, {c: ("value",) for c in df.columns}, None)

    # --- graph operators --------------------------------------------------------------------------------------------

    def _sides(self, start: str, relations, direction: str, predicate: str | None = None, distinct: bool = False) -> tuple[DataFrame, list[str], list]:
        """Edge rows seen from the start: _from, _from_label, _to, _to_label and the edge's columns; labels reached; relations."""
        labels = self.tags[start][1]
        parts, reached, used = [], [], []
        for way in ("out", "in") if direction == "both" else (direction,):
            own = self.graph.schema.matching(relations, src=labels if way == "out" else None, dst=labels if way == "in" else None)
            for r in own:
                e = self.graph.edges([r.name], [r.src], [r.dst], predicate)
                a, b = ("src", "dst") if way == "out" else ("dst", "src")
                parts.append(e.withColumns({"_from": F.col(a), "_from_label": F.col(f"{a}_label"), "_to": F.col(b), "_to_label": F.col(f"{b}_label")}))
                reached.append(r.dst if way == "out" else r.src)
                used.append(r)
        if not parts:
            raise QueryError(f"no relation {relations!r} goes {direction} from {labels}")
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        if distinct:
            rows = rows.select("_from", "_from_label", "_to", "_to_label").distinct()
        return rows, list(dict.fromkeys(reached)), used

    def _start(self, start: str | None) -> tuple[str, Column, Column]:
        name = self._tag(start)
        kind = self.tags[name][0]
        if kind not in ("vertex", "path"):
            raise QueryError(f"{name} is not a vertex or path")
        return name, F.col(f"{name}__{'id' if kind == 'vertex' else 'end'}"), F.col(f"{name}__label")

    def expand(self, start: str | None = None, relations=None, direction: str = "out", opt: str = "vertex", alias: str | None = None, predicate: str | None = None, edge_alias: str | None = None) -> GraphQuery:
        """Neighbours of a vertex or of a path's end. `opt`: "vertex", "edge" or "degree" (0 is kept). `predicate` is on the edge."""
        name, key, label = self._start(start)
        new = self._fresh(alias)
        rows, reached, used = self._sides(name, relations, direction, predicate)
        single = len(self.tags[name][1]) == 1
        if opt == "degree":
            counts = rows.groupBy("_from", "_from_label").agg(F.count(F.lit(1)).alias("_n"))
            df = self.df.join(counts, (key == F.col("_from")) & (label == F.col("_from_label")), "left")
            df = df.withColumn(new, F.coalesce("_n", F.lit(0).cast("long"))).drop("_from", "_from_label", "_n")
            return self._with(df, self.tags | {new: ("value",)}, new)
        on = key == F.col("_from") if single else (key == F.col("_from")) & (label == F.col("_from_label"))
        tags, keep = dict(self.tags), []
        props = [c for c in rows.columns if not c.startswith("_")]
        for edge in ([new] if opt == "edge" else []) + ([edge_alias] if edge_alias else []):
            keep += [F.col(c).alias(f"{edge}__{c}") for c in props] + [F.col("_from").alias(f"{edge}__from"), F.col("_from_label").alias(f"{edge}__from_label")]
            tags[edge] = ("edge", tuple(used))
        if opt == "vertex":
            keep += [F.col("_to").alias(f"{new}__id"), F.col("_to_label").alias(f"{new}__label")]
            tags[new] = ("vertex", tuple(reached))
        right = rows.select("_from", "_from_label", *keep)
        return self._with(self.df.join(right, on).drop("_from", "_from_label"), tags, new)

    def get_v(self, edge: str | None = None, opt: str = "end", alias: str | None = None, predicate: str | None = None) -> GraphQuery:
        """A vertex of an edge: "start", "end", "other" (than the one expanded from) or "both" (two rows); of a path its end."""
        name = self._tag(edge)
        new = self._fresh(alias)
        kind = self.tags[name]
        if kind[0] == "path":
            df = self.df.withColumns({f"{new}__id": F.col(f"{name}__end"), f"{new}__label": F.col(f"{name}__label")})
            return self._with(df, self.tags | {new: ("vertex", kind[1])}, new)._filtered(predicate)
        src = F.struct(F.col(f"{name}__src").alias("id"), F.col(f"{name}__src_label").alias("label"))
        dst = F.struct(F.col(f"{name}__dst").alias("id"), F.col(f"{name}__dst_label").alias("label"))
        starts, ends = [r.src for r in kind[1]], [r.dst for r in kind[1]]
        if opt == "both":
            df = self.df.withColumn("_v", F.explode(F.array(src, dst)))
        elif opt == "other":
            # Ids are unique in a label only
            at_start = (F.col(f"{name}__from") == F.col(f"{name}__src")) & (F.col(f"{name}__from_label") == F.col(f"{name}__src_label"))
            df = self.df.withColumn("_v", F.when(at_start, dst).otherwise(src))
        else:
            df = self.df.withColumn("_v", src if opt == "start" else dst)
        labels = {"start": starts, "end": ends}.get(opt, starts + ends)
        df = df.withColumns({f"{new}__id": F.col("_v.id"), f"{new}__label": F.col("_v.label")}).drop("_v")
        return self._with(df, self.tags | {new: ("vertex", tuple(dict.fromkeys(labels)))}, new)._filtered(predicate)

    def path_expand(self, lo: int, hi: int, start: str | None = None, relations=None, direction: str = "out", path: str = "arbitrary", result: str = "all_v", alias: str | None = None, predicate: str | None = None) -> GraphQuery:
        """Paths of lo to hi - 1 hops, unrolled into joins. "simple" paths visit no vertex twice. With result "end_v" and arbitrary paths
        no ids but the end are carried."""
        if not 0 <= lo < hi:
            raise QueryError("hops need 0 <= lo < hi")
        name, key, label = self._start(start)
        new = self._fresh(alias)
        ids, simple = result == "all_v", path == "simple"
        vertex = lambda label, i: F.struct(label.alias("label"), i.alias("id"))
        now = self.df.withColumns({f"{new}__end": key, f"{new}__label": label, f"{new}__len": F.lit(0), **({f"{new}__path": F.array(key)} if ids else {}), **({f"{new}__seen": F.array(vertex(label, key))} if simple else {})})
        labels, levels, reached = self.tags[name][1], [], set()
        for hop in range(hi):
            if hop >= lo:
                levels.append(now)
                reached |= set(labels)
            if hop == hi - 1:
                break
            step = self._with(now, self.tags | {new: ("path", tuple(labels))}, new)
            try:
                rows, labels, _ = step._sides(new, relations, direction, predicate)
            except QueryError:
                break  # no relation goes on from here
            right = rows.select("_from", "_from_label", "_to", "_to_label")
            on = (F.col(f"{new}__end") == F.col("_from")) & (F.col(f"{new}__label") == F.col("_from_label"))
            to = vertex(F.col("_to_label"), F.col("_to"))
            if simple:
                on = on & ~F.array_contains(f"{new}__seen", to)
            now = now.join(right, on).withColumns(
                {
                    f"{new}__end": F.col("_to"),
                    f"{new}__label": F.col("_to_label"),
                    f"{new}__len": F.lit(hop + 1),
                    **({f"{new}__path": F.array_append(f"{new}__path", F.col("_to"))} if ids else {}),
                    **({f"{new}__seen": F.array_append(f"{new}__seen", to)} if simple else {}),
                }
            )
            now = now.drop("_from", "_from_label", "_to", "_to_label")
        if not levels:
            levels, reached = [now.where(F.lit(False))], set(labels)
        df = reduce(DataFrame.unionByName, levels)
        if simple:
            df = df.drop(f"{new}__seen")
        return self._with(df, self.tags | {new: ("path", tuple(sorted(reached)))}, new)

    def intersect(self, starts: list[tuple], alias: str | None = None, distinct_edges: bool = False) -> GraphQuery:
        """Common neighbours: `starts` are (tag, relations, direction). Multiplicities of parallel edges multiply; with `distinct_edges` they collapse."""
        new = self._fresh(alias)
        df, labels = self.df, None
        for k, (tag, relations, direction) in enumerate(starts):
            name, key, label = self._start(tag)
            rows, reached, _ = self._sides(name, relations, direction, None, distinct_edges)
            labels = reached if labels is None else [x for x in labels if x in reached]
            right = rows.select("_from", "_from_label", "_to", "_to_label")
            on = (key == F.col("_from")) & (label == F.col("_from_label"))
            if k:
                on = on & (F.col(f"{new}__id") == F.col("_to")) & (F.col(f"{new}__label") == F.col("_to_label"))
            df = df.join(right, on)
            if not k:
                df = df.withColumns({f"{new}__id": F.col("_to"), f"{new}__label": F.col("_to_label")})
            df = df.drop("_from", "_from_label", "_to", "_to_label")
        return self._with(df, self.tags | {new: ("vertex", tuple(labels))}, new)

    def edge_check(self, start: str, end: str, relations=None, distinct: bool = False, negated: bool = False) -> GraphQuery:
        """Rows with an edge from start to end; once an edge, or once a row with `distinct`; rows without one with `negated`."""
        a, ka, la = self._start(start)
        b, kb, lb = self._start(end)
        found = self.graph.schema.matching(relations, self.tags[a][1], self.tags[b][1])
        rows = self.graph.edges([r.name for r in found], self.tags[a][1], self.tags[b][1]).select(F.col("src").alias("_s"), F.col("src_label").alias("_sl"), F.col("dst").alias("_d"), F.col("dst_label").alias("_dl"))
        on = (ka == F.col("_s")) & (kb == F.col("_d")) & (la == F.col("_sl")) & (lb == F.col("_dl"))
        kind = "left_anti" if negated else "left_semi" if distinct else "inner"
        return self._with(self.df.join(rows, on, kind).drop("_s", "_sl", "_d", "_dl"))

    def as_(self, alias: str) -> GraphQuery:
        """Give the head another name."""
        old = self._tag(None)
        new = self._fresh(alias)
        df = self.df
        for c in df.columns:
            if c == old or c.startswith(f"{old}__"):
                df = df.withColumnRenamed(c, new + c[len(old) :])
        return self._with(df, {new if k == old else k: v for k, v in self.tags.items()}, new)

    def auxilia(self, tag: str | None = None, columns: tuple[str, ...] = (), predicate: str | None = None, alias: str | None = None, drop: tuple[str, ...] = ()) -> GraphQuery:
        """Fetch properties, filter, rename and drop tags. A vertex that is not in the graph goes with its row."""
        out = self.fetch(tag, *columns)
        name = out._tag(tag)
        if out.tags[name][0] == "vertex":
            there = out.graph.vertices(out.tags[name][1], []).select(F.col("id").alias("_i"), F.col("label").alias("_l"))
            out = out._with(out.df.join(there, (F.col(f"{name}__id") == F.col("_i")) & (F.col(f"{name}__label") == F.col("_l")), "left_semi"))
        out = out._with(out.df, head=name)._filtered(predicate)
        out = out.as_(alias) if alias else out
        return out.drop(*drop) if drop else out

    def drop(self, *tags: str) -> GraphQuery:
        gone = {self._tag(t) for t in tags}
        df = self.df.drop(*[c for c in self.df.columns if c in gone or c.partition("__")[0] in gone])
        return self._with(df, {k: v for k, v in self.tags.items() if k not in gone}, None if self.head in gone else self.head)

    # --- relational operators ---------------------------------------------------------------------------------------

    def _filtered(self, predicate: str | Column | None) -> GraphQuery:
        if predicate is None:
            return self
        out = self._prepared(predicate)
        condition = predicate if isinstance(predicate, Column) else Compiler(out.df, out.column).predicate(predicate)
        return out._with(out.df.where(condition))

    def where(self, predicate: str | Column) -> GraphQuery:
        return self._filtered(predicate)

    def project(self, mappings: dict[str, str | Column], append: bool = False, drop_null: bool | None = None) -> GraphQuery:
        """New tags by expression, instead of all tags or beside them. A single mapping drops rows without a value, unless `drop_null` says otherwise."""
        out = self._prepared(*mappings.values())
        columns = [out._value(x).alias(n) for n, x in mappings.items()]
        tags = {n: ("value",) for n in mappings}
        df = out.df.select("*", *columns) if append else out.df.select(*columns)
        if drop_null if drop_null is not None else len(mappings) == 1 and not append:
            df = df.where(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in mappings]))
        return out._with(df, (out.tags | tags) if append else tags, list(mappings)[-1])

    def join(self, other: GraphQuery, keys: list[tuple[str, str]] | list[str] = (), kind: str = "inner", null_safe: bool = False) -> GraphQuery:
        """Equi-join on expressions of both sides (a name or text for both, or pairs). Of tags on both sides the left one's values stay; in
        right and full joins key tags have the value of the side that has one."""
        pairs = [(k, k) if isinstance(k, str) else k for k in keys]
        pairs = [tuple(x if not x.isidentifier() else f"@{x}" for x in p) for p in pairs]
        left, right = self._prepared(*[p[0] for p in pairs]), other._prepared(*[p[1] for p in pairs])
        rdf = right.df.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in right.df.columns], *[right._value(p[1]).alias(f"_k{i}") for i, p in enumerate(pairs)])
        if kind == "times":
            joined = left.df.crossJoin(rdf)
        else:
            sides = [(left._value(p[0]), F.col(f"_k{i}")) for i, p in enumerate(pairs)]
            on = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in sides])
            joined = left.df.join(rdf, on, JOINS[kind])
        if kind in ("semi", "anti"):
            return left._with(joined)
        same = [c for c in right.df.columns if c in left.df.columns]
        columns = []
        for c in left.df.columns:
            both = c in same and kind in ("right", "full")
            columns.append((F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")) if both else F.col(f"`{c}`")).alias(c))
        columns += [F.col(f"`_r_{c}`").alias(c) for c in right.df.columns if c not in same]
        return left._with(joined.select(*columns), right.tags | left.tags, None)

    def union(self, *others: GraphQuery) -> GraphQuery:
        """All rows of all queries."""
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [q.df for q in others], self.df)
        tags = dict(self.tags)
        for q in others:
            for name, kind in q.tags.items():
                tags[name] = kind if name not in tags or kind[0] == "value" else (kind[0], tuple(dict.fromkeys((*tags[name][1], *kind[1]))))
        return self._with(df, tags)

    def group_by(self, keys: dict[str, str | Column], aggs: dict[str, tuple]) -> GraphQuery:
        """`aggs`: alias -> (function, expression...). Without keys one row is made; ("count",) counts rows."""
        if self.counter and not keys and all(tuple(x) == ("count",) for x in aggs.values()):
            return self._with(self.counter().select(*[F.col("n").alias(a) for a in aggs]), {n: ("value",) for n in aggs}, list(aggs)[-1])
        used = [x for _, *xs in aggs.values() for x in xs]
        out = self._prepared(*keys.values(), *used)
        columns = [aggregate(name, *[out._value(x) for x in xs]).alias(alias) for alias, (name, *xs) in aggs.items()]
        df = out.df.groupBy(*[out._value(x).alias(n) for n, x in keys.items()]).agg(*columns) if keys else out.df.agg(*columns)
        return out._with(df, {n: ("value",) for n in [*keys, *aggs]}, list(aggs)[-1])

    def order_by(self, *keys: tuple[str, str] | str, limit: int | None = None) -> GraphQuery:
        """Keys as (expression, "asc" | "desc" | "shuffle"); NULL is the smallest. With `limit` a top-k."""
        pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
        out = self._prepared(*[k for k, _ in pairs])
        ways = {"asc": lambda c: c.asc_nulls_first(), "desc": lambda c: c.desc_nulls_last(), "shuffle": lambda c: F.rand()}
        df = out.df.orderBy(*[ways[w](out._value(k)) for k, w in pairs])
        return out._with(df if limit is None else df.limit(limit))

    def limit(self, upper: int) -> GraphQuery:
        """At most `upper` rows."""
        return self._with(self.df.limit(upper))

    def dedup(self, *keys: str, order: tuple[str, ...] = ()) -> GraphQuery:
        """One row per value of the keys; with `order` the first in that order, else any."""
        out = self._prepared(*keys, *order)
        named = {f"_d{i}": out._value(k) for i, k in enumerate(keys)}
        if not order:
            return out._with(out.df.withColumns(named).dropDuplicates(list(named)).drop(*named))
        rows = F.struct(*[F.col(f"`{c}`") for c in out.df.columns])
        best = out.df.groupBy(*[c.alias(n) for n, c in named.items()]).agg(F.min_by(rows, F.struct(*[out._value(k) for k in order])).alias("_row"))
        return out._with(best.select("_row.*"))

    def unfold(self, tag: str, alias: str | None = None) -> GraphQuery:
        """A row per element of a collection, which goes; empty and missing ones yield none."""
        name = self._tag(tag)
        if self.tags[name][0] != "value":
            raise QueryError(f"{name} is not a collection")
        new = self._fresh(alias)
        df = self.df.withColumn(new, F.explode(F.col(f"`{name}`"))).drop(name)
        return self._with(df, {k: v for k, v in self.tags.items() if k != name} | {new: ("value",)}, new)

    def apply(self, task: Callable[[GraphQuery], GraphQuery], kind: str = "inner", alias: str | None = None, on: str | None = None, agg: tuple | None = None, first: tuple[str, ...] | None = None) -> GraphQuery:
        """Correlated subtask from a vertex tag (the head by default), decorrelated into a join.

        "semi" and "anti" test whether the task yields rows. "inner" and "left" attach one value: an aggregate of the task's rows, (function, expression...), or the
        head of the first row in the order `first`. Counts of nothing are 0, so "inner" keeps those rows.
        """
        name = self._tag(on)
        key = [f"{name}__id", f"{name}__label"]
        outer = self._with(self.df.select(*key).distinct(), {name: self.tags[name]}, name)
        inner = task(outer)
        if kind in ("semi", "anti"):
            return self._with(self.df.join(inner.df.select(*key).distinct(), key, JOINS[kind]))
        if kind not in ("inner", "left"):
            raise QueryError(f"apply has no kind {kind!r}")
        new = self._fresh(alias)
        if agg:
            function, *xs = agg
            inner = inner._prepared(*xs)
            rows = inner.df.groupBy(*key).agg(aggregate(function, *[inner._value(x) for x in xs]).alias(new))
        elif first:
            inner = inner._prepared(*first)
            rows = inner.df.groupBy(*key).agg(F.min_by(inner.column(None, None), F.struct(*[inner._value(x) for x in first])).alias(new))
        else:
            raise QueryError("a subtask needs an aggregate or an order")
        counted = bool(agg) and agg[0] in ("count", "count_distinct")
        df = self.df.join(rows, key, "left" if kind == "left" or counted else "inner")
        if counted:
            df = df.withColumn(new, F.coalesce(F.col(new), F.lit(0).cast("long")))
        return self._with(df, self.tags | {new: ("value",)}, new)

    def segment_apply(self, keys: tuple[str, ...], function: Callable, schema: str) -> GraphQuery:
        """A pandas function per group of rows with equal keys; a group must fit in a worker's memory."""
        out = self._prepared(*keys)
        df = out.df.groupBy(*[out._value(k).alias(f"_k{i}") for i, k in enumerate(keys)]).applyInPandas(function, schema)
        return out._with(df, {c: ("value",) for c in df.columns}, None)

    def key_by(self, *keys: str, partitions: int | None = None) -> GraphQuery:
        """Rows with equal keys to the same partition."""
        out = self._prepared(*keys)
        columns = [out._value(k) for k in keys]
        return out._with(out.df.repartition(partitions, *columns) if partitions else out.df.repartition(*columns))

    def shuffle(self, partitions: int) -> GraphQuery:
        return self._with(self.df.repartition(partitions))

    # --- patterns ---------------------------------------------------------------------------------------------------

    def match(self, sentences: list[tuple], labels: dict[str, str | None] | None = None, predicates: dict[str, str] | None = None, catalogue=None) -> GraphQuery:
        """Bindings of a pattern (homomorphisms: vertices and edges may coincide).

        Sentences are (start, relation, end), (start, relation, end, "inner" | "semi" | "anti"), the relation prefixed by "<" if it goes from end to start. Tags of the
        outer query can't be used. Semi and anti sentences are tested after all inner ones; an end of theirs may be unbound.
        """
        from ..plans.matching import matched

        return matched(self, sentences, labels or {}, predicates or {}, catalogue)

    # --- sinks ------------------------------------------------------------------------------------------------------

    def sink(self, *tags: str) -> DataFrame:
        """The tags (all by default) as a table: a vertex as its id, an edge as src and dst, a path as its ids or end."""
        columns = []
        for name in tags or self.tags:
            kind = self.tags[self._tag(name)][0]
            if kind == "edge":
                columns += [F.col(f"{name}__{x}").alias(f"{name}_{x}") for x in ("src", "dst")]
            elif kind == "path":
                columns.append(F.col(f"{name}__{'path' if f'{name}__path' in self.df.columns else 'end'}").alias(name))
            else:
                columns.append(self.column(name, None).alias(name))
        return self.df.select(*columns)

    def select(self, **mappings: str | Column) -> DataFrame:
        """Expressions as a table."""
        return self.project(mappings, drop_null=False).df
