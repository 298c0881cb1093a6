"""Ids that are unique in a label only, symmetric patterns, predicates in scans, and streams dealt over several partitions."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from weft.operators.query import GraphQuery
from weft.plans.pattern import Pattern
from weft.sources.graph import PropertyGraph
from weft.sources.schema import Relation
from weft.streaming.stream import Stream


@pytest.fixture(scope="module")
def twins(spark):
    """A and B have the same ids."""
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    return PropertyGraph({"A": ids, "B": ids}, {Relation("A", "r", "B"): spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "src long, dst long")})


def test_other_end(twins):
    q = GraphQuery(twins).scan("B", "b").expand("b", "r", "in", "edge", "e").get_v("e", "other", "v")
    found = {(r.b, r.label, r.v) for r in q.select(b="@b", label="@v.~label", v="@v").collect()}
    assert found == {(1, "A", 1), (2, "A", 1), (2, "A", 2)}


def test_simple_paths(twins):
    q = GraphQuery(twins).scan("A", "a").path_expand(1, 4, "a", "r", "both", path="simple", alias="p")
    found = {tuple(r.p) for r in q.sink("a", "p").collect()}
    assert found == {(1, 1), (1, 2), (2, 2), (1, 2, 2), (2, 2, 1), (2, 2, 1, 1)}


@pytest.mark.parametrize(
    "sentences",
    [
        [("a", "b"), ("b", "c"), ("c", "a")],
        [("a", "b"), ("b", "c"), ("a", "c")],
        [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")],
        [("a", "b"), ("b", "a")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")],
    ],
)
@pytest.mark.parametrize("symmetric", [False, True])
def test_symmetric_patterns(spark, sentences, symmetric):
    """Bindings with their multiplicities against all choices of vertices; loops and parallel edges occur."""
    edges = [(1, 2), (2, 3), (3, 1), (3, 1), (1, 1), (2, 4), (4, 2), (3, 4), (4, 1), (3, 3)]
    if symmetric:
        edges = [x for a, b in edges for x in ([(a, b), (b, a)] if a != b else [(a, b)])]
    graph = PropertyGraph({"N": spark.range(1, 5)}, {Relation("N", "r", "N"): spark.createDataFrame(edges, "src long, dst long")}, symmetric=["r"] if symmetric else [])
    names = sorted({x for s in sentences for x in s})
    rows = GraphQuery(graph).match([(a, "r", b) for a, b in sentences]).sink(*names).collect()
    ours = {}
    for r in rows:
        key = tuple(r[n] for n in names)
        ours[key] = ours.get(key, 0) + 1
    want = {}
    for values in product(range(1, 5), repeat=len(names)):
        at, n = dict(zip(names, values, strict=True)), 1
        for a, b in sentences:
            n *= edges.count((at[a], at[b]))
        if n:
            want[values] = n
    assert ours == want


def test_automorphisms():
    ring = Pattern.of(dict.fromkeys(range(4), "N"), [(0, 1, "r"), (1, 2, "r"), (2, 3, "r"), (3, 0, "r")])
    assert len(ring.automorphisms()) == 4 and len(ring.automorphisms(frozenset(["r"]))) == 8
    assert ring.automorphisms()[0] == {0: 0, 1: 1, 2: 2, 3: 3}
    assert len(Pattern.of({0: "N", 1: "N", 2: "M"}, [(0, 1, "r"), (1, 2, "s"), (0, 2, "s")]).automorphisms()) == 1


def test_predicates_reach_scans(spark, tmp_path):
    """A predicate of a pattern is a filter of the file scan, and its rows are right."""
    people = spark.createDataFrame([(i, i * 10) for i in range(20)], "id long, age int")
    people.write.parquet(f"{tmp_path}/people")
    knows = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "src long, dst long")
    graph = PropertyGraph({"P": spark.read.parquet(f"{tmp_path}/people")}, {Relation("P", "knows", "P"): knows})
    q = GraphQuery(graph).match([("a", "knows", "b"), ("b", "knows", "c")], predicates={"b": "@b.age > 170"})
    plan = q.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(age), GreaterThan(age,170)" in plan
    assert {(r.a, r.b, r.c) for r in q.sink("a", "b", "c").collect()} == {(17, 18, 19), (18, 19, 0)}


def test_zip_of_many_partitions(spark):
    """Wide and narrow sides, whose exchanges differ in bytes."""
    n = 20_000
    a = spark.range(n).select(F.col("id").alias("a"), F.repeat(F.lit("payload"), 30).alias("payload"))
    b = spark.range(n).select((F.col("id") * 2).alias("b"))
    rows = Stream(a.repartition(7)).zip(Stream(b.repartition(3)), ("a",), ("b",)).df
    assert rows.count() == n and rows.where("b != 2 * a OR payload IS NULL").isEmpty()


def test_reduce_and_accumulators(spark):
    class Longest:
        """The longest word, the least of several."""

        def __init__(self):
            self.word = None

        def add(self, value):
            if value is not None and (self.word is None or (-len(value), value) < (-len(self.word), self.word)):
                self.word = value

        def merge(self, other):
            self.add(other.word)

        def result(self):
            return self.word

    rows = [(k, w) for k, words in {1: ["a", "bbb", "aaa"], 2: ["zz", "y"], 3: [None]}.items() for w in words]
    words = Stream(spark.createDataFrame(rows, "k long, w string").repartition(4)).key_by("k")
    found = words.accumulate_by_key(Longest, "w", "k long, w string").df
    assert {(r.k, r.w) for r in found.collect()} == {(1, "aaa"), (2, "zz"), (3, None)}
    more = lambda x, y: {"k": x["k"], "v": x["v"] + y["v"]}
    numbers = Stream(spark.createDataFrame([(i % 3, i) for i in range(100)], "k long, v long").repartition(5)).key_by("k")
    assert {(r.k, r.v) for r in numbers.reduce_by_key(more).df.collect()} == {(k, sum(range(k, 100, 3))) for k in range(3)}
    total = numbers.reduce(lambda x, y: {"k": 0, "v": x["v"] + y["v"]}).df.collect()
    assert len(total) == 1 and total[0].v == sum(range(100))
    assert numbers.filter("v > 1000").reduce(more).df.collect() == []
    assert sum(r.v for r in numbers.reduce_partition(more).df.collect()) == sum(range(100))


@pytest.mark.parametrize("base,exponent", [(3, 39), (-7, 21), (2, 62), (10, 0), (0, 5), (-1, 1001), (1, 999), (2, 63), (5, 100), (-3, 3)])
def test_power(spark, base, exponent):
    """By literal and by column, as Python has it; beyond 64 bits NULL."""
    table = spark.createDataFrame([(base, exponent)], "b long, e long")
    q = GraphQuery(PropertyGraph({}, {})).scan_table(table)
    row = q.project({"x": f"@b ^^ {exponent}", "y": "@b ^^ @e"}, append=True).df.first()
    want = base**exponent if -(2**63) <= base**exponent < 2**63 else None
    assert row.x == want and row.y == want
