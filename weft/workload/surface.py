"""Registered queries over the rest of the surface: options of scans, files, dataflow operators, statistics, and what is refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import iterate
from ..operators.query import GraphQuery, QueryError
from ..plans.catalogue import Catalogue, folder_selectivities, sparsified
from ..plans.job_planner import JoinPlanner
from ..plans.lower import executed
from ..plans.pattern import Pattern, PatternError
from ..plans.planner import Planner, QueryGraph, fixed_hops
from ..plans.sql_where import classified
from ..sources import files, scratch
from ..sources.graph import order_graph
from ..streaming.stream import Stream
from .operators import CYCLE_SQL, cycle_catalogue, cycle_query, graph_query, read
from .social import PERSON, walks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def registered(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return registered


def rows(spark, values, schema):
    return spark.createDataFrame(list(values), schema)


# --- scans ----------------------------------------------------------------------------------------------------------


@query("SELECT least(7, count(*)) AS n, true AS fit FROM orders WHERE o_totalprice > 100000")
def scan_steps(spark, sf_dir):
    """The predicate comes before the limit."""
    t = order_graph(spark, sf_dir).vertices("Order", predicate="@.totalprice > 100000", sample=1.0, seed=3, limit=7)
    return t.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("totalprice") > 100000).alias("fit"))


@query("SELECT 0 AS strangers, true AS near_half")
def scan_sampled(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    some, every = g.vertices("Order", ["id"], sample=0.5, seed=7), g.vertices("Order", ["id"])
    n = every.agg(F.count(F.lit(1)).alias("n"))
    strangers = some.join(every, "id", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return some.agg(F.count(F.lit(1)).alias("k")).crossJoin(n).crossJoin(strangers).select("strangers", F.expr("k BETWEEN 0.4 * n AND 0.6 * n").alias("near_half"))


@query("SELECT p_partkey AS p FROM part WHERE p_size IN (1, 2, 3)")
def expr_array_within(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").where("[@p.size, @p.size] within [1, 2, 3]").sink("p")


# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS c, o_orderkey AS o, o_orderdate AS made, o_orderpriority AS priority FROM orders")
def files_delimited(spark, sf_dir):
    """Orders and the edges to them written as delimited text, and read back as a graph."""
    root = scratch.path(spark, "delimited")
    o = read(spark, sf_dir, "orders")
    made = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("creationDate")
    o.select(F.col("o_orderkey").alias("id"), made, F.col("o_orderpriority").alias("priority")).write.option("sep", "|").option("header", True).csv(f"{root}/order")
    o.select(F.col("o_custkey").alias("from"), F.col("o_orderkey").alias("to")).write.option("sep", "|").option("header", True).csv(f"{root}/placed")
    read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).write.option("header", True).csv(f"{root}/customer")
    catalog = {
        "nodes": {"Order": {"csv": "order", "delimiter": files.sniffed_delimiter(spark, f"{root}/order"), "properties": ["id", "creationDate", "priority"]}, "Customer": {"csv": "customer"}},
        "edges": {"placed": {"csv": "placed", "source_label": "Customer", "target_label": "Order", "source_column": "from", "target_column": "to"}},
    }
    q = GraphQuery(files.read_social_graph(spark, root, catalog)).scan("Customer", "c").expand("c", "placed", alias="o")
    return q.select(c="@c", o="@o", made="@o.creationDate", priority="@o.priority")


@query("""SELECT 'Customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem
    UNION ALL SELECT 'supplies', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem""")
def files_graph(spark, sf_dir):
    """The graph written, read back with its schema, and counted."""
    root = scratch.path(spark, "graph")
    files.write_graph(order_graph(spark, sf_dir), root)
    g = files.read_graph(spark, root)
    parts = [g.vertices(x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("what"), "n") for x in ("Customer", "Order")]
    parts += [g.edges(x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("what"), "n") for x in ("placed", "contains", "supplies")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query("""SELECT s_suppkey AS s, n_nationkey AS n, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000""")
def files_sink_graph(spark, sf_dir):
    """A graph of what a query found, and a query over that graph."""
    q = graph_query(spark, sf_dir).scan("Supplier", "s", "@.acctbal > 5000").expand("s", "supplierIn", opt="edge", alias="e").get_v("e", "end", "n")
    small = files.sink_graph(q, ["s", "n"], ["e"], scratch.path(spark, "sink"))
    out = GraphQuery(small).scan("Supplier", "s").expand("s", "supplierIn", alias="n")
    return out.select(s="@s", n="@n", name="@n.name")


@query("SELECT 'orders' AS source, 'big' AS name, cast(count_if(o_totalprice > 100000) AS bigint) AS matched, count(*) AS total FROM orders UNION ALL SELECT 'nation', 'early', cast(count_if(n_name < 'G') AS bigint), count(*) FROM nation")
def files_selectivities(spark, sf_dir):
    """Selectivities straight from a folder of delimited files with different delimiters."""
    root = scratch.path(spark, "folder")
    for name, sep in (("orders", ";"), ("nation", "|")):
        read(spark, sf_dir, name).write.option("sep", sep).option("header", True).csv(f"{root}/{name}.csv")
    found = folder_selectivities(spark, root, {"orders": {"big": "o_totalprice > 100000"}, "nation": {"early": "n_name < 'G'"}})
    return rows(spark, [(t, n, found[t][n]["matched_rows"], found[t][n]["total_rows"]) for t, n in (("orders", "big"), ("nation", "early"))], "source string, name string, matched long, total long")


# --- graph operators ------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey AS r, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey")
def expand_from_path(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").path_expand(2, 3, "o", ["suppliedBy", "supplierIn"], alias="p").expand("p", "partOf", alias="r")
    return q.group_by({"r": "@r"}, {"n": ("count",)}).df.withColumn("r", F.col("r").cast("int"))


@query("SELECT n_nationkey AS n, n_name AS name FROM nation")
def order_shuffled(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Nation", "n").order_by(("@n", "shuffle")).select(n="@n", name="@n.name").withColumn("n", F.col("n").cast("int"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def key_by_and_shuffle(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").shuffle(5).key_by("@o.status", partitions=3)
    return q.group_by({"status": "@o.status"}, {"n": ("count",)}).df


@query("SELECT unnest(['apply right', 'apply without aggregate', 'disconnected pattern', 'missing start', 'outer tag in pattern', 'pattern without inner sentence', 'wrong direction']) AS refused")
def refusals(spark, sf_dir):
    """What must be an error, by trying."""
    g = graph_query(spark, sf_dir)
    c = g.scan("Customer", "c")
    tries = {
        "apply right": lambda: c.apply(lambda x: x.expand("c", "placed", alias="o"), "right"),
        "apply without aggregate": lambda: c.apply(lambda x: x.expand("c", "placed", alias="o"), "inner"),
        "disconnected pattern": lambda: g.match([("a", "placed", "b"), ("s", "supplierIn", "n")]),
        "missing start": lambda: c.expand("nobody", "placed"),
        "outer tag in pattern": lambda: c.match([("c", "placed", "o")]),
        "pattern without inner sentence": lambda: g.match([("a", "placed", "b", "anti")]),
        "wrong direction": lambda: c.expand("c", "partOf"),
    }
    refused = []
    for what, run in tries.items():
        try:
            run()
        except (QueryError, PatternError):
            refused.append((what,))
    return rows(spark, refused, "refused string")


# --- dataflow -------------------------------------------------------------------------------------------------------


def events(spark, sf_dir) -> Stream:
    return Stream(read(spark, sf_dir, "events"))


@query("""SELECT 'map' AS what, event_id * 2 AS x FROM events UNION ALL SELECT 'filter_map', event_id FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'flat_map', unnest(range(event_id % 3)) FROM events UNION ALL SELECT 'switch', event_id FROM events WHERE NOT coalesce(value > 20, false)""")
def stream_rows(spark, sf_dir):
    s = events(spark, sf_dir)
    named = lambda t, what: t.map(what=F.lit(what), x="cast(x as bigint)")
    out = named(s.map(x="event_id * 2"), "map").merge(named(s.filter_map(x="CASE WHEN event_type = 'click' THEN event_id END"), "filter_map"))
    out = out.merge(named(s.filter("event_id % 3 > 0").unfold("x", "sequence(0, cast(event_id % 3 as int) - 1)"), "flat_map"))
    return out.merge(named(s.switch("value > 20")[1].map(x="event_id"), "switch")).df


@query("""SELECT 'any' AS what, 1 AS n UNION ALL SELECT 'any of none', 0 UNION ALL SELECT 'broadcast', count(*) FROM events JOIN nation ON n_nationkey = event_id % 25 UNION ALL SELECT 'collect', count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'copied', 2 * count(*) FROM events UNION ALL SELECT 'count', count(*) FROM events UNION ALL SELECT 'limit', least(9, count(*)) FROM events UNION ALL SELECT 'limit_partition', 8
    UNION ALL SELECT 'one partition', count(*) FROM events UNION ALL SELECT 'parts', 4 UNION ALL SELECT 'rows of parts', count(*) FROM events UNION ALL SELECT 'unary', count(*) FROM events WHERE event_id % 2 = 0""")
def stream_counts(spark, sf_dir):
    s = events(spark, sf_dir).map(event_id="event_id", event_type="event_type")
    four = s.repartition(4)
    nation = Stream(read(spark, sf_dir, "nation").selectExpr("n_nationkey AS k"), ("k",)).broadcast()
    joined = Stream(s.df.selectExpr("event_id % 25 AS k"), ("k",)).join(nation)
    a, b = s.copied()
    n = lambda t, what: t.fold(what=F.lit(what), n="count(*)")
    parts = four.fold_partition(n="count(*)")
    out = [
        n(s, "count"), n(s.limit(9), "limit"), n(four.limit_partition(2), "limit_partition"), n(parts, "parts"), parts.fold(what=F.lit("rows of parts"), n="sum(n)"), n(joined, "broadcast"), n(a.merge(b), "copied"), n(s.aggregate(), "one partition"),
        Stream(s.key_by("event_type").dedup().collect("event_type").df.select(F.lit("collect").alias("what"), F.size("event_type").cast("long").alias("n"))),
        n(s.unary(lambda frames: (f[f.event_id % 2 == 0] for f in frames), "event_id long, event_type string"), "unary"),
        Stream(rows(spark, [("any", int(s.any())), ("any of none", int(s.filter("event_id < 0").any()))], "what string, n long")),
    ]
    whole = out[0]
    for t in out[1:]:
        whole = whole.merge(t)
    return whole.df


@query("""SELECT 'reduce' AS what, '' AS k, max(event_id) AS x FROM events UNION ALL SELECT 'reduce_by_key', event_type, sum(event_id) FROM events GROUP BY event_type
    UNION ALL SELECT 'accumulate', event_type, max(event_id) - min(event_id) FROM events GROUP BY event_type""")
def stream_user_functions(spark, sf_dir):
    """A user's Python function of two rows, over all rows and by key, and a user's accumulator."""

    class Spread:
        def __init__(self):
            self.ends = []

        def add(self, value):
            self.ends = [min([value, *self.ends]), max([value, *self.ends])]

        def merge(self, other):
            for x in other.ends:
                self.add(x)

        def result(self):
            return self.ends[1] - self.ends[0]

    s = events(spark, sf_dir).map(k="event_type", x="cast(event_id as bigint)").key_by("k")
    biggest = s.reduce(lambda a, b: a if a["x"] >= b["x"] else b).map(what=F.lit("reduce"), k=F.lit(""), x="x")
    summed = s.reduce_by_key(lambda a, b: {"k": a["k"], "x": a["x"] + b["x"]}).map(what=F.lit("reduce_by_key"), k="k", x="x")
    spread = s.accumulate_by_key(Spread, "x", "k string, x long").map(what=F.lit("accumulate"), k="k", x="x")
    return biggest.merge(summed).merge(spread).df


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 12")
def stream_sort_limit(spark, sf_dir):
    return events(spark, sf_dir).sort_limit(12, F.desc_nulls_last("value"), "event_id").map(event_id="event_id", value="value").df


@query("""SELECT 0 AS side, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM supplier""")
def stream_tagged(spark, sf_dir):
    a = Stream(read(spark, sf_dir, "customer").selectExpr("c_custkey AS k"))
    b = Stream(read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name AS name"))
    return a.merge_tagged(b).key_by("side").fold_by_key(n="count(*)").df


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    return events(spark, sf_dir).map(user_id="user_id").key_by("user_id").dedup().df


_E, _C = "(SELECT user_id AS k FROM events WHERE value > 10) e", "(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c"


@query(" UNION ALL ".join(f"SELECT '{name}' AS kind, count(*) AS n FROM {_E} {sql} JOIN {_C} ON e.k = c.k" for name, sql in {"inner": "", "left": "LEFT", "right": "RIGHT", "full": "FULL", "left_semi": "SEMI", "left_anti": "ANTI"}.items()))
def stream_joins(spark, sf_dir):
    e = events(spark, sf_dir).filter("value > 10").map(k="cast(user_id as bigint)").key_by("k").partition_by_key()
    c = Stream(read(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("cast(c_custkey as bigint) AS j"), ("j",))
    parts = [e.join(c, kind).fold(kind=F.lit(kind), n="count(*)") for kind in ("inner", "left", "right", "full", "left_semi", "left_anti")]
    out = parts[0]
    for p in parts[1:]:
        out = out.merge(p)
    return out.df


@query("SELECT user_id, max(clicks) AS clicks FROM (SELECT user_id, NULL AS clicks FROM events UNION ALL SELECT user_id, count(*) FROM events WHERE event_type = 'click' GROUP BY user_id) GROUP BY user_id")
def stream_apply(spark, sf_dir):
    """Keys without a click have NULL."""
    s = events(spark, sf_dir).map(user_id="user_id", event_type="event_type").key_by("user_id")
    return s.apply(lambda t: t.filter("event_type = 'click'"), clicks="count(*)").map(user_id="user_id", clicks="clicks").df.distinct()


@query("SELECT event_type, median(event_id) AS mid FROM events GROUP BY event_type")
def stream_segment_apply(spark, sf_dir):
    s = events(spark, sf_dir).map(event_type="event_type", event_id="event_id").key_by("event_type")
    return s.segment_apply(lambda f: f.groupby("event_type", as_index=False).agg(mid=("event_id", "median")), "event_type string, mid double").df


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def stream_binary(spark, sf_dir):
    import pandas as pd

    def sizes(key, left, right):
        return pd.DataFrame([(key[0], len(left), len(right))], columns=["k", "customers", "suppliers"])

    a = Stream(read(spark, sf_dir, "customer").selectExpr("c_nationkey AS k"))
    b = Stream(read(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k"))
    return a.binary(b, "k", sizes, "k int, customers long, suppliers long").df


@query("""WITH RECURSIVE r AS (SELECT s_suppkey AS x, 0 AS t FROM supplier UNION ALL SELECT x * 3, t + 1 FROM r WHERE t < 4 AND (t = 0 OR x <= 200)) SELECT x, count(*) AS n FROM r GROUP BY x""")
def iterate_emitted(spark, sf_dir):
    start = read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) AS x")
    return iterate.iterate_emit(start, lambda d: d.withColumn("x", F.col("x") * 3), 4, "x > 200").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT o_totalprice / 100000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), one AS (SELECT -avg((0.5 - y) * x) AS a, -avg(0.5 - y) AS b FROM d),
    two AS (SELECT avg((1 / (1 + exp(-(a * x + b))) - y) * x) AS ga, avg(1 / (1 + exp(-(a * x + b))) - y) AS gb FROM d, one) SELECT round(a - ga, 6) AS weight, round(b - gb, 6) AS constant FROM one, two""")
def regression(spark, sf_dir):
    """Two steps of gradient descent."""
    d = read(spark, sf_dir, "orders").selectExpr("o_totalprice / 100000 AS x", "CASE WHEN o_orderstatus = 'F' THEN 1.0D ELSE 0.0D END AS y")
    w = iterate.logistic_regression(d, ["x"], "y", turns=2)
    return rows(spark, [(round(w[0], 6), round(w[1], 6))], "weight double, constant double")


# --- statistics and plans -------------------------------------------------------------------------------------------


def _lines() -> Pattern:
    return Pattern.of({0: "Customer", 1: "Order", 2: "Part"}, [(0, 1, "placed"), (1, 2, "contains")])


@query("""WITH e AS (SELECT (SELECT count(*) FROM orders)::double * (SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders) AS x)
    SELECT 'estimate' AS what, round(x, 3) AS x FROM e UNION ALL SELECT 'random', round(x, 3) FROM e UNION ALL SELECT 'stored', (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey)::double UNION ALL SELECT 'read back', round(x, 3) FROM e
    UNION ALL SELECT 'schema', (SELECT count(*) FROM nation)::double""")
def catalogue_estimates(spark, sf_dir):
    """Counts of two vertices, what follows from them for three, and the count of three itself."""
    g = order_graph(spark, sf_dir)
    two, three = Catalogue.from_patterns(g, [_lines()], 2), Catalogue.from_patterns(g, [_lines()], 3)
    small = Catalogue.from_schema(g, 1)
    found = [("estimate", two.estimate(_lines())), ("random", two.estimate_random(_lines())), ("stored", three.estimate(_lines())), ("read back", Catalogue.from_json(two.to_json()).estimate(_lines()))]
    found.append(("schema", small.estimate(Pattern.of({0: "Nation"}, []))))
    return rows(spark, [(k, round(float(v), 3)) for k, v in found], "what string, x double")


@query("SELECT true AS near")
def catalogue_sparsified(spark, sf_dir):
    """Counts on a thinned graph, corrected by the rates, are near those of the whole."""
    g = order_graph(spark, sf_dir)
    rates = {"contains": 0.5}
    exact = Catalogue.from_patterns(g, [_lines()], 3).estimate(_lines())
    thin = Catalogue.from_patterns(sparsified(g, rates), [_lines()], 3).estimate(_lines()) / 0.5
    return rows(spark, [(0.8 < thin / exact < 1.25,)], "near boolean")


@query("SELECT unnest([3, 1, 2]) AS classes, unnest(['directions', 'renamings', 'sub-patterns of two']) AS of")
def pattern_codes(spark, sf_dir):
    """Classes of patterns by canonical code, after edits."""
    path = Pattern.of({0: "Customer", 1: "Customer"}, [(0, 1, "knows")]).extended(2, "Customer", [(1, 2, "knows")])
    renamed = [Pattern.of({a: "Customer", b: "Customer", c: "Customer"}, [(a, b, "knows"), (b, c, "knows")]) for a, b, c in ((0, 1, 2), (2, 0, 1), (1, 2, 0))]
    ways = [Pattern.of(dict.fromkeys(range(3), "Customer"), e) for e in ([(0, 1, "knows"), (1, 2, "knows")], [(0, 1, "knows"), (0, 2, "knows")], [(1, 0, "knows"), (2, 0, "knows")])]
    subs = {p.code() for p in (path.without_vertex(2), path.without_edge(path.edges[0]), Pattern.of({5: "Customer"}, []))}
    return rows(spark, [(len({p.code() for p in ways}), "directions"), (len({p.code() for p in [path, *renamed]}), "renamings"), (len(subs), "sub-patterns of two")], "classes int, of string")


_WHERE = "o.o_custkey = c.c_custkey AND o.o_totalprice BETWEEN 1000 AND 200000 AND (c.c_acctbal > 0 OR o.o_orderstatus = 'F') AND c.c_mktsegment <> 'x AND y' AND c.c_nationkey = n.n_nationkey AND n.n_name LIKE '%A%'"


@query(f"SELECT n.n_name AS nation, count(*) AS n FROM orders o, customer c, nation n WHERE {_WHERE} GROUP BY n.n_name")
def where_classes(spark, sf_dir):
    """A WHERE clause taken apart: filters go to their tables, equalities join, the rest comes last."""
    found = classified(_WHERE)
    tables = {"o": "orders", "c": "customer", "n": "nation"}
    sides = {}
    for alias, name in tables.items():
        t = read(spark, sf_dir, name).alias(alias)
        for f in found.filters.get(alias, []):
            t = t.where(f)
        sides[alias] = t
    (a, x, b, y), *more = found.joins
    df, bound = sides[a].join(sides[b], F.expr(f"{a}.{x} = {b}.{y}")), {a, b}
    for a, x, b, y in more:
        new = b if a in bound else a
        df, bound = df.join(sides[new], F.expr(f"{a}.{x} = {b}.{y}")), bound | {new}
    for r in found.residual:
        df = df.where(r)
    return df.groupBy(F.col("n.n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n, true AS checked {CYCLE_SQL}")
def plan_join_cycle(spark, sf_dir):
    """A join template that closes a cycle: its plan has an edge check."""
    graph, q = order_graph(spark, sf_dir), cycle_query()
    planner = Planner(q, cycle_catalogue(graph))
    join = JoinPlanner(planner)
    df = executed(planner.left_deep(join.order()), graph, q)
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("checked", F.lit(any(s.kind == "EDGECHECK" for s in join.best()[1])))


# What a friend is asked for in each text with a variable-length edge: hops, and edges (name, from, to) from the friend b on.
SHAPES = {
    "ic_1": (1, 3, [("customerIn", "b", "n")]),
    "ic_3": (1, 2, [("placed", "b", "o"), ("suppliedBy", "o", "s"), ("supplierIn", "s", "n")]),
    "ic_5": (1, 2, [("placed", "b", "o"), ("suppliedBy", "o", "s")]),
    "ic_6": (1, 2, [("placed", "b", "o"), ("contains", "o", "p")]),
    "ic_9": (1, 2, [("placed", "b", "o")]),
    "ic_10": (2, 2, [("customerIn", "b", "n"), ("placed", "b", "o")]),
    "ic_11": (1, 2, [("customerIn", "b", "n"), ("partOf", "n", "r")]),
}
LABELS = {"a": "Customer", "b": "Customer", "n": "Nation", "o": "Order", "p": "Part", "r": "Region", "s": "Supplier"}
_JOINS = {
    ("customerIn", "b", "n"): "JOIN customer cn ON cn.c_custkey = w.b",
    ("partOf", "n", "r"): "JOIN nation ON n_nationkey = cn.c_nationkey",
    ("placed", "b", "o"): "JOIN orders ON o_custkey = w.b",
    ("contains", "o", "p"): "JOIN lineitem lp ON lp.l_orderkey = o_orderkey",
    ("suppliedBy", "o", "s"): "JOIN lineitem ls ON ls.l_orderkey = o_orderkey",
    ("supplierIn", "s", "n"): "JOIN supplier ON s_suppkey = ls.l_suppkey",
}
_HOPS = [(name, hops, edges) for name, (lo, hi, edges) in SHAPES.items() for hops in range(lo, hi + 1)]


def hop_pattern(name: str) -> dict:
    """A pattern file with a variable-length edge."""
    lo, hi, edges = SHAPES[name]
    aliases = list(dict.fromkeys(["a", "b", *[x for _, s, d in edges for x in (s, d)]]))
    vertices = [{"tag_id": i, "alias": x, "label": LABELS[x], "label_id": i} for i, x in enumerate(aliases)]
    every = [("knows", "a", "b", lo, hi, True), *[(r, s, d, 1, 1, False) for r, s, d in edges]]
    found = [
        {"edge_id": i, "alias": None, "type": r, "relation_id": i, "relation_label": r, "source_tag": aliases.index(s), "target_tag": aliases.index(d), "min_hops": x, "max_hops": y, "is_var_expand": var, "is_identity": False, "is_reversed": False}
        for i, (r, s, d, x, y, var) in enumerate(every)
    ]
    person = {"combined": {"expression": f"id = {PERSON}", "selectivity": 0.001}}
    return {"query": name, "match": {"vertices": vertices, "edges": found}, "sql": {"vertices": [], "edges": []}, "aliases": {"a": person}, "alias_domains": dict.fromkeys(aliases, "match")}


@query(f"WITH {walks(1, 3)} " + " UNION ALL ".join(f"SELECT '{name}-{hops}' AS query, count(*) AS n FROM (SELECT b FROM w WHERE distance = {hops}) w {' '.join(_JOINS[e] for e in edges)}" for name, hops, edges in _HOPS))
def plan_hop_patterns(spark, sf_dir):
    """Fourteen patterns, one per number of hops of each variable-length edge, planned and executed each."""
    graph = order_graph(spark, sf_dir).stored("knows")
    every = Pattern.of({0: "Customer", 1: "Customer", 2: "Order", 3: "Part", 4: "Supplier", 5: "Nation", 6: "Region"}, [(0, 1, "knows"), (0, 2, "placed"), (2, 3, "contains"), (2, 4, "suppliedBy"), (4, 5, "supplierIn"), (0, 5, "customerIn"), (5, 6, "partOf")])
    catalogue, out = Catalogue.levelled(graph, [every], 2), None
    for name, hops, _ in _HOPS:
        data = fixed_hops(hop_pattern(name), hops)
        q = QueryGraph.from_json(data)
        part = executed(Planner(q, catalogue).best(), graph, q).agg(F.lit(data["query"]).alias("query"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionAll(part)
    return out
