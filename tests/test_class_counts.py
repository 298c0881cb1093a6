"""Bindings of patterns over classes, counted without being made, against the bindings themselves and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.operators.query import GraphQuery
from weft.sources.graph import PropertyGraph
from weft.sources.schema import Relation
from weft.workload.operators import QUERIES, SQL

KNOWS = Relation("N", "knows", "N")


def clique_graph(spark, rows):
    t = spark.createDataFrame(rows, "id long, x int, y string")
    edges = t.join(t.withColumnRenamed("id", "dst"), ["x", "y"]).where("id != dst").select(F.col("id").alias("src"), "dst")
    return PropertyGraph({"N": t}, {KNOWS: edges}, symmetric=["knows"], classes={KNOWS: ("x", "y")})


@pytest.mark.parametrize("sentences", [["ab"], ["ab", "bc"], ["ab", "bc", "ca"], ["ab", "ba"], ["ab", "bc", "cd", "da"], ["ab", "bc", "ca", "aa"], ["ab", "ac", "ad", "bc"]])
def test_counts_are_those_of_the_bindings(spark, sentences):
    """Repeated rows, classes of one, and missing ids and values occur."""
    rows = [(1, 1, "p"), (2, 1, "p"), (3, 1, "p"), (3, 1, "p"), (4, 1, "p"), (5, 1, "q"), (6, 1, "q"), (7, 2, "q"), (8, None, "p"), (9, None, "p"), (None, 1, "p"), (10, 1, None), (11, 3, "r"), (12, 3, "r"), (13, 3, "r")]
    q = GraphQuery(clique_graph(spark, rows)).match([(a, "knows", b) for a, b in sentences])
    found = q.group_by({}, {"n": ("count",), "m": ("count",)}).df
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect() == [(q.df.count(), q.df.count())] and dict(found.dtypes) == {"n": "bigint", "m": "bigint"}


def test_other_counts_use_the_bindings(spark):
    q = GraphQuery(clique_graph(spark, [(i, i % 2, "p") for i in range(7)])).match([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a")])
    assert q.group_by({}, {"n": ("count",)}).df.first().n == 24 + 6
    assert q.where("@a < 2").group_by({}, {"n": ("count",)}).df.first().n == 6 + 2
    assert q.limit(5).group_by({}, {"n": ("count",)}).df.first().n == 5
    assert {r.a: r.n for r in q.group_by({"a": "@a"}, {"n": ("count",)}).df.collect()} == {i: 6 if i % 2 == 0 else 2 for i in range(7)}
    none = GraphQuery(clique_graph(spark, [])).match([("a", "knows", "b"), ("b", "knows", "c")])
    assert none.group_by({}, {"n": ("count",)}).df.first().n == 0


@pytest.mark.parametrize("rows", [[], [(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (2, 2, "B"), (3, 1, "A"), (4, 2, "B"), (4, 2, "B"), (5, None, "A")]])
def test_triangles_of_odd_customers(spark, tmp_path, rows):
    """Customers with several rows, in one class or in two, and none at all, against DuckDB."""
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    t = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").withColumns({"c_name": F.lit("c"), "c_acctbal": F.lit(1.0)})
    t.write.parquet(f"file://{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert [tuple(r) for r in QUERIES["match_triangle"](spark, f"file://{tmp_path}").collect()] == con.execute(SQL["match_triangle"]).fetchall()


def test_large_classes(spark, tmp_path):
    """20,000 members have 8 x 10^12 triangles: no plan that makes them ends."""
    graph = PropertyGraph({"N": spark.range(20_000).withColumn("x", F.lit(1))}, {KNOWS: spark.createDataFrame([], "src long, dst long")}, classes={KNOWS: ("x",)})
    q = GraphQuery(graph).match([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a")])
    assert q.group_by({}, {"n": ("count",)}).df.first().n == 20_000 * 19_999 * 19_998
