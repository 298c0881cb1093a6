"""Property graphs over DataFrames: one table per vertex label and one per relation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import Compiler
from . import scratch
from .schema import GraphSchema, Relation


#: Edges that a stored relation may have to be broadcast: 16 bytes each, 32 MB.
BROADCAST_EDGES = 2_000_000


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


class PropertyGraph:
    """Vertex tables have column `id` (long, unique in the label); edge tables have `src` and `dst`, and may be bags."""

    def __init__(self, vertices: dict[str, DataFrame], edges: dict[Relation, DataFrame], schema: GraphSchema | None = None, symmetric: Iterable[str] = (), classes: dict[Relation, tuple[str, ...]] | None = None):
        """`symmetric` names relations that have every edge in both directions, equally often. `classes` has the relations that join any two vertex rows of one
        label which have different ids and the same values, none missing, in the columns given."""
        self.symmetric = frozenset(symmetric)
        self.classes = dict(classes or {})
        #: Relations whose edges were counted and are few enough to be broadcast.
        self.small: frozenset[Relation] = frozenset()
        self.vertex_tables, self.edge_tables = vertices, edges
        self.schema = schema or GraphSchema(
            {n: dict(t.dtypes) for n, t in vertices.items()},
            {r: dict(t.dtypes) for r, t in edges.items()},
            dict(enumerate(vertices)),
            dict(enumerate(dict.fromkeys(r.name for r in edges))),
        )

    def labels_of(self, labels: str | Iterable[str] | None) -> list[str]:
        names = list(self.vertex_tables) if labels is None else [labels] if isinstance(labels, (str, int)) else list(labels)
        return [self.schema.label(n) for n in names]

    def columns_of(self, labels: Iterable[str]) -> list[str]:
        return list(dict.fromkeys(c for n in labels for c in self.vertex_tables[n].columns))

    def vertices(self, labels=None, columns=None, predicate: str | None = None, ids=None, sample: float | None = None, seed: int | None = None, limit: int | None = None) -> DataFrame:
        """`label`, `id` and the other columns (or those asked for). In this order: ids and predicate, sample, limit."""
        tables = []
        for name in self.labels_of(labels):
            t = self.vertex_tables[name]
            t = t if columns is None else t.select("id", *[c for c in columns if c in t.columns and c != "id"])
            t = t.withColumn("label", F.lit(name))
            tables.append(t)
        return self._scanned(_union(tables), predicate, ids, sample, seed, limit)

    def edges(self, relations=None, src=None, dst=None, predicate: str | None = None, sample: float | None = None, seed: int | None = None, limit: int | None = None) -> DataFrame:
        """`label`, `src_label`, `src`, `dst_label`, `dst` and the edges' columns."""
        found = self.schema.matching(relations, src, dst)
        if not found:
            raise ValueError(f"no relation {relations!r} between {src} and {dst}")
        tables = [self.edge_tables[r].withColumns({"label": F.lit(r.name), "src_label": F.lit(r.src), "dst_label": F.lit(r.dst)}) for r in found]
        return self._scanned(_union(tables), predicate, None, sample, seed, limit)

    @staticmethod
    def _scanned(df: DataFrame, predicate, ids, sample, seed, limit) -> DataFrame:
        if ids is not None:
            df = df.where(F.col("id").isin(list(ids)))
        if predicate is not None:
            df = df.where(Compiler(df, lambda tag, prop: F.col((prop or tag or "id").lstrip("~"))).predicate(predicate))
        if sample is not None:
            df = df.sample(fraction=sample, seed=seed)
        return df if limit is None else df.limit(limit)

    def stored(self, *relations: str) -> PropertyGraph:
        """The edges of the relations, which may be costly to derive, written once and read from there; to be used where a query reads them several times."""
        edges = {r: scratch.written(t, "edges") if r.name in relations else t for r, t in self.edge_tables.items()}
        out = PropertyGraph(self.vertex_tables, edges, self.schema, self.symmetric, self.classes)
        out.small = frozenset(r for r, t in edges.items() if r.name in relations and t.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES)
        return out

    def lookup(self, label: str, column: str, value) -> DataFrame:
        """Vertices of one label by primary key; the comparison reaches the scan."""
        return self.vertices(label).where(F.col(column) == F.lit(value))

    def degrees(self, relations=None, direction: str = "out") -> DataFrame:
        """`label`, `id` and `degree` of vertices that have an edge."""
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        e = self.edges(relations)
        sides = [e.select(F.col(f"{x}_label").alias("label"), F.col(x).alias("id")) for x in ends]
        return reduce(DataFrame.unionAll, sides).groupBy("label", "id").agg(F.count(F.lit(1)).alias("degree"))

    def kth_edge(self, relations, k: int, direction: str = "out", order: tuple[str, ...] = ("src", "dst")) -> DataFrame:
        """The k-th edge (from 1) of each vertex in the given order."""
        end = "src" if direction == "out" else "dst"
        own = Window.partitionBy(f"{end}_label", end).orderBy(*order)
        return self.edges(relations).withColumn("k", F.row_number().over(own)).where(F.col("k") == k).drop("k")


def order_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Graph view of the order tables.

    `contains` and `suppliedBy` are bags (an order may have several lines of a part or supplier); `knows` joins customers of one nation and market segment.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    named = lambda df, key, **cols: df.select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(n) for n, c in cols.items()])
    vertices = {
        "Customer": named(t["customer"], "c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment", nationkey="c_nationkey"),
        "Order": named(t["orders"], "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        "Part": named(t["part"], "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", retailprice="p_retailprice"),
        "Supplier": named(t["supplier"], "s_suppkey", name="s_name", acctbal="s_acctbal"),
        "Nation": named(t["nation"], "n_nationkey", name="n_name"),
        "Region": named(t["region"], "r_regionkey", name="r_name"),
    }
    edge = lambda df, s, d, **cols: df.select(F.col(s).cast("long").alias("src"), F.col(d).cast("long").alias("dst"), *[F.col(c).alias(n) for n, c in cols.items()])
    line = t["lineitem"]
    c = t["customer"]
    other = c.select(F.col("c_custkey").alias("k2"), "c_nationkey", "c_mktsegment")
    edges = {
        Relation("Customer", "placed", "Order"): edge(t["orders"], "o_custkey", "o_orderkey", orderdate="o_orderdate"),
        Relation("Order", "contains", "Part"): edge(line, "l_orderkey", "l_partkey", line="l_linenumber", quantity="l_quantity", price="l_extendedprice", discount="l_discount", shipdate="l_shipdate"),
        Relation("Order", "suppliedBy", "Supplier"): edge(line, "l_orderkey", "l_suppkey", line="l_linenumber", quantity="l_quantity", price="l_extendedprice", discount="l_discount", shipdate="l_shipdate"),
        Relation("Supplier", "supplies", "Part"): edge(line, "l_suppkey", "l_partkey").distinct(),
        Relation("Customer", "customerIn", "Nation"): edge(c, "c_custkey", "c_nationkey"),
        Relation("Supplier", "supplierIn", "Nation"): edge(t["supplier"], "s_suppkey", "s_nationkey"),
        Relation("Nation", "partOf", "Region"): edge(t["nation"], "n_nationkey", "n_regionkey"),
        Relation("Customer", "knows", "Customer"): edge(c.join(other, ["c_nationkey", "c_mktsegment"]).where("c_custkey != k2"), "c_custkey", "k2"),
    }
    return PropertyGraph(vertices, edges, symmetric=["knows"], classes={Relation("Customer", "knows", "Customer"): ("nationkey", "segment")})


def modern_graph(spark: SparkSession) -> PropertyGraph:
    """Six vertices and six edges: a small graph for examples and tests."""
    vertices = {
        "person": spark.createDataFrame([(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)], "id long, name string, age int"),
        "software": spark.createDataFrame([(3, "lop", "java"), (5, "ripple", "java")], "id long, name string, lang string"),
    }
    edges = {
        Relation("person", "knows", "person"): spark.createDataFrame([(1, 2, 0.5), (1, 4, 1.0)], "src long, dst long, weight double"),
        Relation("person", "created", "software"): spark.createDataFrame([(1, 3, 0.4), (4, 3, 0.4), (4, 5, 1.0), (6, 3, 0.2)], "src long, dst long, weight double"),
    }
    return PropertyGraph(vertices, edges)
