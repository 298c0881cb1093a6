import itertools
import json
import random

import pytest

from weft.plans.catalogue import Catalogue, counted, selectivities, sparsified
from weft.plans.job_planner import JoinPlanner
from weft.plans.lower import executed
from weft.plans.matching import ordered_plan
from weft.plans.pattern import Edge, Pattern, PatternError, patterns_of
from weft.plans.pattern_planner import PatternPlanner, heuristic_order, query_graph
from weft.plans.planner import Link, Planner, QueryGraph, Vertex, fixed_hops
from weft.plans.render import rendered
from weft.plans.sql_where import classified
from weft.sources.graph import modern_graph, order_graph
from weft.sources.schema import SchemaError

CYCLE = Pattern.of({0: "Customer", 1: "Order", 2: "Supplier", 3: "Nation"}, [(0, 1, "placed"), (1, 2, "suppliedBy"), (2, 3, "supplierIn"), (0, 3, "customerIn")])


@pytest.fixture(scope="module")
def graph(spark):
    return order_graph(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def catalogue(graph):
    return Catalogue.from_patterns(graph, [CYCLE], 2)


def ids(df, n):
    return sorted(tuple(r) for r in df.select(*[f"v{i}__id" for i in range(n)]).collect())


def test_every_plan_gives_the_same_rows(graph, catalogue):
    q = query_graph(CYCLE)
    planner = Planner(q, catalogue)
    expected = ids(executed(planner.best(), graph, q), 4)
    assert expected
    for order in itertools.islice(planner.orders(), 0, None, 4):
        assert ids(executed(planner.left_deep(order), graph, q), 4) == expected
    for space in ("extend", "join", "hybrid"):
        assert ids(executed(PatternPlanner(CYCLE, catalogue, space).best(), graph, q), 4) == expected
    assert ids(executed(ordered_plan(q, heuristic_order(q)), graph, q), 4) == expected
    halves = planner.merged(planner.left_deep(["v0", "v1"]), planner.left_deep(["v2", "v3"]))
    assert ids(executed(halves, graph, q), 4) == expected
    assert ids(executed(planner.best(), graph, q, distinct=True), 4) == sorted(set(expected))


def test_best_is_the_cheapest(catalogue):
    planner = Planner(query_graph(CYCLE), catalogue)
    best = planner.best()
    assert all(best.cost <= planner.left_deep(o).cost + 1e-9 for o in planner.orders())
    assert "EDGE CHECK" in rendered(planner.left_deep(["v0", "v1", "v2", "v3"]), planner.query)
    assert rendered(best, planner.query).startswith(f"shape: {best.shape()}")


def test_join_planner(graph, catalogue):
    planner = Planner(query_graph(CYCLE), catalogue)
    jobs = JoinPlanner(planner)
    cost, steps = jobs.best()
    assert cost <= min(jobs.greedy(a)[0] for a in planner.query.vertices)
    assert [s.kind for s in steps].count("VERTEX_SCAN") == 1 and [s.kind for s in steps].count("EDGECHECK") == 1
    assert "AGGREGATE" in jobs.rendered()
    assert len(ids(executed(planner.left_deep(jobs.order()), graph, planner.query), 4)) == counted(graph, CYCLE)


def test_known_costs():
    q = QueryGraph({"a": Vertex("a", "A", selectivity=0.5), "b": Vertex("b", "B")}, [Link("a", "b", "r")])
    counts = {Pattern.of({0: "A"}, []).code(): 10.0, Pattern.of({0: "B"}, []).code(): 100.0, Pattern.of({0: "A", 1: "B"}, [(0, 1, "r")]).code(): 40.0}
    best = Planner(q, Catalogue(counts)).best()
    assert (best.kind, best.alias, best.frequency) == ("merge", None, 20.0) or best.alias == "b"
    assert Planner(q, Catalogue(counts), merges=False).best().cost == pytest.approx(0.1 * 5 + 0.1 * 20)
    with pytest.raises(KeyError):
        Planner(q, Catalogue({})).best()
    zero = QueryGraph({"a": Vertex("a", "A", selectivity=0.0), "b": Vertex("b", "B")}, [Link("a", "b", "r")])
    assert Planner(zero, Catalogue(counts)).best().frequency < 1e-6


def test_estimates(graph, catalogue):
    edge = CYCLE.with_edges(CYCLE.edges[:1])
    assert catalogue.estimate(edge) == counted(graph, edge) == 1500
    assert catalogue.estimate(CYCLE) > 0 and catalogue.estimate_random(CYCLE) > 0
    exact = Catalogue.from_patterns(graph, [CYCLE], 4)
    assert exact.estimate(CYCLE) == counted(graph, CYCLE)
    again = Catalogue.from_json(exact.to_json())
    assert again.counts == exact.counts and len(again.printed().splitlines()) == len(again.counts)


def test_counting_by_levels(graph, tmp_path, spark):
    """Without a limit all counts are exact; with one they are near, and every sample is within it."""
    exact = Catalogue.from_patterns(graph, [CYCLE], 4)
    assert Catalogue.levelled(graph, [CYCLE], 4).counts == exact.counts
    near = Catalogue.levelled(graph, [CYCLE], 4, limit=1500)
    for code, n in exact.counts.items():
        assert len(code[0]) < 3 and near.counts[code] == n or 0.6 * n <= near.counts[code] <= 1.5 * n, (code, n, near.counts[code])
    near.save(spark, f"file://{tmp_path}/catalogue")
    assert Catalogue.load(spark, f"file://{tmp_path}/catalogue").counts == near.counts


def test_estimate_by_hand():
    path = Pattern.of({0: "A", 1: "B", 2: "C"}, [(0, 1, "r"), (1, 2, "s")])
    counts = {Pattern.of({0: x}, []).code(): n for x, n in (("A", 5.0), ("B", 10.0), ("C", 20.0))}
    counts |= {Pattern.of({0: "A", 1: "B"}, [(0, 1, "r")]).code(): 30.0, Pattern.of({0: "B", 1: "C"}, [(0, 1, "s")]).code(): 40.0}
    assert Catalogue(counts).estimate(path) == pytest.approx(30 * 40 / 10)


def test_codes_do_not_depend_on_names():
    rng = random.Random(3)
    square = [(0, 1, "r"), (1, 2, "r"), (2, 3, "r"), (3, 0, "r")]
    p = Pattern.of({i: "A" for i in range(4)}, square)
    for _ in range(10):
        names = rng.sample(range(50), 4)
        q = Pattern(tuple(sorted((n, "A") for n in names)), tuple(Edge(i, names[a], names[b], r) for i, (a, b, r) in enumerate(square)))
        assert q.code() == p.code()
    turned = Pattern.of({i: "A" for i in range(4)}, [(0, 1, "r"), (1, 2, "r"), (2, 3, "r"), (0, 3, "r")])
    assert turned.code() != p.code()


def test_pattern_edits(spark):
    schema = modern_graph(spark).schema
    p = Pattern.of({0: "person", 1: "person", 2: "software"}, [(0, 1, "knows"), (1, 2, "created"), (0, 2, "created")]).validated(schema)
    assert Pattern.from_json(json.loads(json.dumps(p.to_json(schema))), schema) == p
    assert len(p.without_vertex(2).edges) == 1 and len(p.without_edge(p.edges[0]).edges) == 2
    assert len(list(p.sub_patterns(2))) == 6 and not list(p.decompositions())  # a triangle has none
    assert len(p.extended(3, "person", [(3, 0, "knows")]).edges) == 4
    with pytest.raises(PatternError):
        Pattern.of({0: "person", 1: "person"}, []).validated()
    with pytest.raises(PatternError):
        Pattern.of({0: "person", 1: "person"}, [(0, 1, "created")]).validated(schema)
    assert len(patterns_of(schema, 2)) == 5
    assert schema.inferred({"x": None, "y": None}, [("x", "y", "created")]) == {"x": {"person"}, "y": {"software"}}
    with pytest.raises(SchemaError):
        schema.inferred({"x": "software", "y": None}, [("x", "y", "knows")])


def test_sampled_counts(spark):
    g = modern_graph(spark)
    p = Pattern.of({0: "person", 1: "person"}, [(0, 1, "knows")])
    assert counted(g, p) == 2
    assert counted(g, p, sampled={"created": 0.5}) == 2
    assert sparsified(g, {"knows": 0.5}).edges("knows").count() <= 2


def test_fixed_hops():
    v = lambda t, a: {"tag_id": t, "alias": a, "label": "P", "label_id": 0}
    e = {"edge_id": 0, "type": "knows", "relation_id": 1, "relation_label": "P_knows_P", "source_tag": 0, "target_tag": 1, "min_hops": 1, "max_hops": 3, "is_var_expand": True, "is_identity": False, "is_reversed": False, "alias": None}
    q = {"query": "q", "match": {"vertices": [v(0, "a"), v(1, "b")], "edges": [e]}, "sql": {"vertices": [], "edges": []}, "alias_domains": {"a": "match", "b": "match"}}
    with pytest.raises(PatternError):
        QueryGraph.from_json(q)
    three = QueryGraph.from_json(fixed_hops(q, 3))
    assert len(three.vertices) == 4 and len(three.links) == 3 and three.connected()
    assert len(QueryGraph.from_json(fixed_hops(q, 1)).links) == 1
    with pytest.raises(PatternError):
        fixed_hops(q, 4)


def test_where_classes():
    w = classified("a.x = 1 AND a.id = b.id AND (b.y LIKE '%AND%' OR b.y IS NULL) AND a.z BETWEEN 1 AND 3 AND a.x + b.x > 2 AND (a.k = c.k)")
    assert w.filters == {"a": ["a.x = 1", "a.z BETWEEN 1 AND 3"], "b": ["(b.y LIKE '%AND%' OR b.y IS NULL)"]}
    assert w.joins == [("a", "id", "b", "id"), ("a", "k", "c", "k")] and w.residual == ["a.x + b.x > 2"]


def test_selectivities(spark):
    t = spark.createDataFrame([(i,) for i in range(10)], "x long")
    found = selectivities(t, {"low": "x < 5", "even": "x % 2 = 0"})
    assert [found[k]["matched_rows"] for k in ("low", "even", "combined")] == [5, 5, 3] and found["combined"]["selectivity"] == 0.3


def test_authored_order_survives(graph, catalogue):
    q = query_graph(CYCLE)
    df = executed(Planner(q, catalogue).left_deep(["v3", "v2", "v1", "v0"]), graph, q)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") >= 3


def test_command_line(spark, tmp_path):
    """Tables, patterns, counts, estimates and a plan of a written graph."""
    from weft.plans.__main__ import run
    from weft.sources.files import write_graph

    root = f"file://{tmp_path}/g"
    write_graph(modern_graph(spark), root)
    assert "edge\tperson-created-software\t4" in run(spark, ["tables", root])
    lines = run(spark, ["patterns", root, "--most", "2"])
    assert len(lines) == len(patterns_of(modern_graph(spark).schema, 2))
    run(spark, ["catalogue", root, f"file://{tmp_path}/c", "--most", "2"])
    path = Pattern.of({0: "person", 1: "person", 2: "software"}, [(0, 1, "knows"), (1, 2, "created")])
    (tmp_path / "p.json").write_text(json.dumps(path.to_json(modern_graph(spark).schema)))
    assert run(spark, ["count", root, str(tmp_path / "p.json")]) == ["2"]
    out = run(spark, ["ceg", f"file://{tmp_path}/c", root, str(tmp_path / "p.json")])
    assert len(out) == 3 and out[-1] == "2\testimate"
    assert run(spark, ["plan", f"file://{tmp_path}/c", root, str(tmp_path / "p.json")])[0].startswith("shape:")
