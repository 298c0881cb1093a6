import pytest

from weft.operators import iterate
from weft.operators.query import GraphQuery
from weft.sources import files
from weft.sources.graph import modern_graph
from weft.streaming.stream import Stream


@pytest.fixture(scope="module")
def numbers(spark):
    return Stream(spark.range(0, 100, 1, 4).selectExpr("id AS x", "id % 10 AS k"))


def values(s, *cols):
    return sorted(tuple(r) for r in s.df.select(*cols).collect())


def test_rows(numbers):
    assert numbers.limit(10).df.count() == 10
    assert numbers.limit_partition(2).df.count() == 8
    assert numbers.filter("x < 5").map(y="x * 2").df.count() == 5
    assert numbers.filter_map(y="CASE WHEN x < 3 THEN x END").df.count() == 3
    assert numbers.filter("x = 2").flat_map("e", "sequence(0, x)").df.count() == 3
    low, high = numbers.branch("x < 30")
    assert (low.df.count(), high.df.count()) == (30, 70)
    assert low.merge(high).df.count() == 100 and low.merge_tagged(high).fold(s="sum(side)").df.first()[0] == 70
    assert numbers.any() and not numbers.filter("x > 1000").any()


def test_folds_and_keys(numbers):
    assert numbers.count().df.first()[0] == 100
    assert numbers.fold(s="sum(x)").df.first()[0] == 4950
    assert numbers.fold_partition(n="count(*)").df.count() == 4
    assert numbers.key_by("k").fold_by_key(n="count(*)").df.count() == 10
    assert numbers.key_by("k").dedup().df.count() == 10
    assert numbers.key_by("k").join(Stream(numbers.df.selectExpr("k AS j", "x AS y").where("j < 2"), ("j",)), "left_semi").df.count() == 20
    assert [r.x for r in numbers.sort_limit(3, "-x").df.collect()] == [99, 98, 97]
    applied = numbers.key_by("k").apply(lambda s: s.filter("x < 20"), n="count(*)")
    assert values(applied, "n")[0] == (2,)
    assert numbers.collect("x").df.first()[0] == list(range(100))
    assert numbers.unary(lambda frames: (f[f.x < 7] for f in frames), "x long, k long").df.count() == 7


def test_zip(spark):
    a = Stream(spark.createDataFrame([(i,) for i in (5, 1, 3)], "a long"))
    b = Stream(spark.createDataFrame([(c,) for c in "zyxw"], "b string"))
    assert values(a.zip(b, ("a",), ("b",)), "a", "b") == [(1, "w"), (3, "x"), (5, "y")]


def test_iteration(spark):
    df = spark.createDataFrame([(1,), (10,)], "x long")
    double = lambda d: d.selectExpr("x * 2 AS x")
    assert sorted(r.x for r in iterate.iterate(df, double, 3).collect()) == [8, 80]
    assert sorted(r.x for r in iterate.iterate_until(df, double, "x >= 16", 3).collect()) == [8, 20]
    assert sorted(r.x for r in iterate.iterate_emit(df, double, 2).collect()) == [1, 2, 4, 10, 20, 40]


def test_graph_algorithms(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    ranks = {r.id: r.rank for r in iterate.page_rank(edges, 1).collect()}
    assert ranks == pytest.approx({1: 1.0, 2: 0.575, 3: 0.575})
    assert sorted(r.id for r in iterate.closure(edges, spark.createDataFrame([(2,)], "id long")).collect()) == [1, 2, 3]
    hops = iterate.k_hop(modern_graph(spark), spark.createDataFrame([(2,)], "source long"), "knows", 2, "both")
    assert sorted((r.id, r.distance) for r in hops.collect()) == [(1, 1), (2, 0), (4, 2)]
    data = spark.createDataFrame([(x / 10, int(x > 5)) for x in range(11)], "x double, y int")
    w = iterate.logistic_regression(data, ["x"], "y", 300, 5.0)
    assert w[0] > 0 and w[0] * 0.1 + w[1] < 0 < w[0] * 0.95 + w[1]


def test_graph_files(spark, tmp_path):
    g = modern_graph(spark)
    files.write_graph(g, str(tmp_path / "g"))
    again = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, again.edges("created").select("src", "dst").collect())) == [(1, 3), (4, 3), (4, 5), (6, 3)]
    q = GraphQuery(g).scan("person", "a", ids=[4]).expand("a", "created", opt="edge", alias="e").get_v("e", "end", "b")
    small = files.sink_graph(q, ["a", "b"], ["e"], str(tmp_path / "s"))
    assert small.vertices("software").count() == 2 and small.edges().count() == 2


def test_delimited_files(spark, tmp_path):
    (tmp_path / "person.csv").write_text("id|firstName|creationDate\n1|Ann|2010-01-02T03:04:05.006+0000\n2|Bo|20100102030405006\n")
    (tmp_path / "knows.csv").write_text("Person.id|Person.id|creationDate\n1|2|2011-01-01\n")
    catalog = {
        "nodes": {"Person": {"csv": "person.csv", "id_column": "id", "properties": ["id", "firstName", "creationDate"]}},
        "edges": {"knows": {"csv": "knows.csv", "source_label": "Person", "target_label": "Person", "source_column": "Person.id", "target_column": "Person.id", "properties": ["creationDate"]}},
    }
    g = files.read_social_graph(spark, str(tmp_path), catalog)
    rows = sorted((r.id, r.firstName, str(r.creationDate)) for r in g.vertices("Person").collect())
    assert rows == [(1, "Ann", "2010-01-02 03:04:05.006000"), (2, "Bo", "2010-01-02 03:04:05.006000")]
    assert [tuple(r) for r in g.edges("knows").select("src", "dst").collect()] == [(1, 2)]
    assert g.vertices("Person").select(files.packed_date("creationDate").alias("p")).first().p == 20100102030405006
    assert files.sniffed_delimiter(spark, str(tmp_path / "person.csv")) == "|"
