"""Pattern statistics: counts collected by Spark jobs, and estimates from them."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files, scratch
from ..sources.graph import PropertyGraph
from .pattern import Edge, Pattern, isomorphism, patterns_of


def bindings(graph: PropertyGraph, pattern: Pattern, rate: float = 1.0, seed: int = 12345, sampled: dict[str, float] | None = None) -> tuple[DataFrame, float]:
    """Homomorphisms of a pattern (columns v<tag>), and what a count of them is to be divided by.

    Edges are joined in an order in which each meets what is bound. With `rate`, the first edge's rows are sampled; `sampled` has rates by
    relation of a sparsified graph.
    """
    labels, factor = pattern.labels, 1.0
    if not pattern.edges:
        t, label = pattern.vertices[0]
        return graph.vertices(label, []).select(F.col("id").alias(f"v{t}")), 1.0
    left, bound, df = list(pattern.edges), set(), None
    while left:
        ready = [e for e in left if not bound or e.src in bound or e.dst in bound]
        closing = [e for e in ready if e.src in bound and e.dst in bound]
        e = (closing or ready)[0]
        left.remove(e)
        rows = graph.edges([e.relation], [labels[e.src]], [labels[e.dst]]).select("src", "dst")
        share = (sampled or {}).get(e.relation, 1.0)
        if share < 1:
            rows, factor = rows.sample(fraction=share, seed=seed), factor * share
        if df is None and rate < 1:
            rows, factor = rows.sample(fraction=rate, seed=seed), factor * rate
        a, b = f"v{e.src}", f"v{e.dst}"
        if e.src == e.dst:
            rows = rows.where("src = dst").select(F.col("src").alias(a))
        else:
            rows = rows.select(F.col("src").alias(a), F.col("dst").alias(b))
        keys = [c for c in rows.columns if df is not None and c in df.columns]
        df = rows if df is None else df.join(rows, keys)
        bound |= {e.src, e.dst}
    return df, factor


def counted(graph: PropertyGraph, pattern: Pattern, rate: float = 1.0, seed: int = 12345, sampled: dict[str, float] | None = None) -> float:
    df, factor = bindings(graph, pattern, rate, seed, sampled)
    return df.count() / factor


@dataclass
class Catalogue:
    """Counts by canonical code; what is not stored is estimated from smaller patterns."""

    counts: dict[tuple, float] = field(default_factory=dict)
    seed: int = 12345

    def __post_init__(self) -> None:
        self._memo: dict[tuple, float] = {}

    @classmethod
    def from_patterns(cls, graph: PropertyGraph, patterns: list[Pattern], most: int = 3, rate: float = 1.0, sampled: dict[str, float] | None = None) -> Catalogue:
        """Counts of the patterns' sub-patterns of at most `most` vertices."""
        out = cls()
        for p in patterns:
            for q in p.sub_patterns(most):
                code = q.code()
                if code not in out.counts:
                    out.counts[code] = counted(graph, q, rate, out.seed, sampled)
        return out

    @classmethod
    def levelled(cls, graph: PropertyGraph, patterns: list[Pattern], most: int = 3, rate: float = 1.0, limit: int = 100_000, seed: int = 12345) -> Catalogue:
        """Counts level by level: a pattern is counted by extending a sample of the bindings of one with a vertex less, and no join is larger than that sample's extension.

        Patterns of one edge are counted exactly. Of a pattern's bindings, a share of `rate`, and of `limit` rows at most by expectation, is kept for those above it; counts of
        those are divided by the shares taken on the way.
        """
        out, kept = cls(seed=seed), {}
        wanted: dict[tuple, Pattern] = {}
        for p in patterns:
            for q in p.sub_patterns(most):
                wanted.setdefault(q.code(), q)
        for code, q in sorted(wanted.items(), key=lambda x: (len(x[1].vertices), len(x[1].edges))):
            parent = cls._parent(q, kept)
            if parent is None:
                df, share = bindings(graph, q)[0], 1.0
            else:
                tag, names, (base, share) = parent
                df = base.withColumnsRenamed({f"v{a}": f"_v{a}" for a in names}).withColumnsRenamed({f"_v{a}": f"v{b}" for a, b in names.items()})
                for e in sorted(q.at(tag), key=lambda e: e.src == e.dst):
                    rows = graph.edges([e.relation], [q.labels[e.src]], [q.labels[e.dst]]).select("src", "dst")
                    if e.src == e.dst:
                        rows = rows.where("src = dst").drop("dst").withColumnRenamed("src", f"v{tag}")
                    else:
                        rows = rows.withColumnsRenamed({"src": f"v{e.src}", "dst": f"v{e.dst}"})
                    df = df.join(rows, [c for c in rows.columns if c in df.columns])
            n = df.count()
            out.counts[code] = n / share
            if any(len(x.vertices) > len(q.vertices) for x in wanted.values()) and len(q.vertices) > 1:
                part = min(rate, limit / max(n, 1))
                sample = df.sample(fraction=part, seed=seed) if part < 1 else df
                kept[code] = q, (scratch.written(sample, "bindings"), share * min(part, 1.0))
        return out

    @staticmethod
    def _parent(q: Pattern, kept: dict):
        """A vertex whose removal leaves a pattern with a sample; the renaming of that sample's tags; the sample."""
        for tag, _ in q.vertices:
            rest = q.without_vertex(tag)
            if len(rest.components()) == 1 and (found := kept.get(rest.code())):
                old = found[0]
                names = isomorphism(old, rest)
                if names is not None:
                    return tag, names, found[1]
        return None

    def save(self, spark, path: str) -> None:
        """Where plans of later sessions find it: statistics are not collected anew for each query."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> Catalogue:
        return cls.from_json(spark.read.text(path).first()[0])

    @classmethod
    def from_schema(cls, graph: PropertyGraph, most: int = 2, rate: float = 1.0) -> Catalogue:
        """Counts of all patterns of at most `most` vertices that the schema allows."""
        return cls.from_patterns(graph, patterns_of(graph.schema, most), most, rate)

    def estimate(self, pattern: Pattern) -> float:
        """The stored count, else the mean over edges that can be removed of F(rest) F(edge) / product of F(shared vertices)."""
        code = pattern.code()
        if code in self.counts:
            return self.counts[code]
        if code not in self._memo:
            values = [v for e in pattern.edges if (v := self._removed(pattern, e, self.estimate)) is not None]
            if not values:
                raise KeyError(f"the catalogue has no statistics for {pattern}")
            self._memo[code] = sum(values) / len(values)
        return self._memo[code]

    def _removed(self, pattern: Pattern, edge: Edge, of) -> float | None:
        if len(pattern.edges) < 2:
            return None
        rest = pattern.without_edge(edge)
        if len(rest.components()) > 1:
            return None
        single = pattern.with_edges((edge,))
        value = of(rest) * of(single)
        for t, label in rest.vertices:
            if t in (edge.src, edge.dst):
                value /= max(of(Pattern(((t, label),), ())), 1.0)
        return value

    def estimate_random(self, pattern: Pattern, samples: int = 10) -> float:
        """As `estimate`, with one edge at random at each step, averaged over samples."""
        rng = random.Random(self.seed)

        def once(p: Pattern) -> float:
            if (c := p.code()) in self.counts:
                return self.counts[c]
            edges = list(p.edges)
            rng.shuffle(edges)
            for e in edges:
                if (v := self._removed(p, e, once)) is not None:
                    return v
            raise KeyError(f"the catalogue has no statistics for {p}")

        return sum(once(pattern) for _ in range(samples)) / samples

    def to_json(self) -> str:
        return json.dumps([[code, n] for code, n in sorted(self.counts.items(), key=repr)])

    @classmethod
    def from_json(cls, text: str) -> Catalogue:
        def frozen(x):
            return tuple(frozen(y) for y in x) if isinstance(x, list) else x

        return cls({frozen(code): n for code, n in json.loads(text)})

    def printed(self) -> str:
        return "\n".join(f"{n:.6g}\t{code}" for code, n in sorted(self.counts.items(), key=repr))


def sparsified(graph: PropertyGraph, rates: dict[str, float], seed: int = 12345) -> PropertyGraph:
    """The graph with each relation's edges sampled at its rate; counts on it are to be divided by the rates of the edges they use."""
    edges = {r: t.sample(fraction=rates[r.name], seed=seed) if rates.get(r.name, 1.0) < 1 else t for r, t in graph.edge_tables.items()}
    return PropertyGraph(graph.vertex_tables, edges, graph.schema)


def aggregated(graph: PropertyGraph) -> DataFrame:
    """Rows per label and relation: kind, src_label, label, dst_label, rows."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("vertex").alias("kind"), F.lit(None).cast("string").alias("src_label"), F.lit(n).alias("label"), F.lit(None).cast("string").alias("dst_label"), "rows") for n, t in graph.vertex_tables.items()]
    parts += [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("edge").alias("kind"), F.lit(r.src).alias("src_label"), F.lit(r.name).alias("label"), F.lit(r.dst).alias("dst_label"), "rows") for r, t in graph.edge_tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def selectivities(table: DataFrame, predicates: dict[str, str]) -> dict[str, dict]:
    """Of SQL predicates on one table: matched rows, rows and selectivity, each and all together, in one pass."""
    both = " AND ".join(f"({p})" for p in predicates.values()) or "TRUE"
    named = {**predicates, "combined": both}
    row = table.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.expr(p)).alias(f"p{i}") for i, p in enumerate(named.values())]).first()
    return {k: {"expression": p, "matched_rows": row[f"p{i}"], "total_rows": row["_n"], "selectivity": row[f"p{i}"] / row["_n"] if row["_n"] else 1.0} for i, (k, p) in enumerate(named.items())}


def folder_selectivities(spark, root: str, predicates: dict[str, dict[str, str]]) -> dict[str, dict[str, dict]]:
    """`selectivities` by table, straight from a folder of delimited files."""
    tables = files.read_folder(spark, root)
    return {name: selectivities(tables[name], own) for name, own in predicates.items()}
