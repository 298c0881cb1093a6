"""One query per operator of the builder, the expressions, patterns, streams and iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iterate
from ..operators.query import GraphQuery
from ..plans.catalogue import Catalogue, aggregated, counted, selectivities
from ..plans.job_planner import JoinPlanner
from ..plans.lower import executed
from ..plans.pattern import Pattern
from ..plans.pattern_planner import PatternPlanner, query_graph
from ..plans.planner import Link, Planner, QueryGraph, Vertex, fixed_hops
from ..sources.graph import order_graph
from ..streaming.stream import Stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

KNOWS = "(SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey)"


def query(sql: str | None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return registered


def graph_query(spark: SparkSession, sf_dir: str) -> GraphQuery:
    return GraphQuery(order_graph(spark, sf_dir))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def scan_vertices(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Order", "o", '@.totalprice > 200000 && @.status == "F"').select(id="@o.~id", price="@o.totalprice")


@query("""SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part
    UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region""")
def scan_all_labels(spark, sf_dir):
    return graph_query(spark, sf_dir).scan(alias="v").group_by({"label": "@v.~label"}, {"n": ("count",)}).df


@query("SELECT l_orderkey AS src, l_suppkey AS dst, l_quantity AS quantity FROM lineitem WHERE l_discount > 0.08")
def scan_edges(spark, sf_dir):
    return graph_query(spark, sf_dir).scan_edges("suppliedBy", "e", "@.discount > 0.08").select(src="@e.src", dst="@e.dst", quantity="@e.quantity")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9, 1000000000)")
def lookup_ids(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c", ids=[1, 5, 9, 1_000_000_000]).select(id="@c.~id", name="@c.name")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def lookup_primary_key(spark, sf_dir):
    first = read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return order_graph(spark, sf_dir).lookup("Nation", "name", first).select(F.col("id").cast("int").alias("id"), "name")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def scan_table(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan_table(read(spark, sf_dir, "events"))
    return q.group_by({"event_type": "@event_type"}, {"n": ("count",), "total": ("sum", "@value")}).df.withColumn("total", F.round("total", 2))


@query("SELECT l_suppkey AS id, count(*) AS degree FROM lineitem GROUP BY l_suppkey")
def degrees_in(spark, sf_dir):
    return order_graph(spark, sf_dir).degrees("suppliedBy", "in").select("id", "degree")


@query("""SELECT src, dst FROM (SELECT l_orderkey AS src, l_partkey AS dst, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 2""")
def kth_edge(spark, sf_dir):
    return order_graph(spark, sf_dir).kth_edge("contains", 2, order=("line", "dst")).select("src", "dst")


# --- graph operators ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def expand_out(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").where("@c.acctbal > 5000").expand("c", "placed", alias="o").sink("c", "o")


@query("SELECT s_suppkey AS s, o_orderkey AS o, o_orderpriority AS priority FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_acctbal < 1000 AND l_quantity > 45")
def expand_in_edge_filter(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Supplier", "s", "@.acctbal < 1000").expand("s", "suppliedBy", "in", alias="o", predicate="@.quantity > 45")
    return q.select(s="@s", o="@o", priority="@o.priority")


@query("""SELECT n_nationkey AS n, 'Region' AS label, count(*) AS k FROM nation GROUP BY n_nationkey
    UNION ALL SELECT c_nationkey, 'Customer', count(*) FROM customer GROUP BY c_nationkey
    UNION ALL SELECT s_nationkey, 'Supplier', count(*) FROM supplier GROUP BY s_nationkey""")
def expand_both(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Nation", "n").expand("n", None, "both", alias="x")
    return q.group_by({"n": "@n", "label": "@x.~label"}, {"k": ("count",)}).df.withColumn("n", F.col("n").cast("int"))


@query("SELECT o_orderkey AS o, l_partkey AS part, l_extendedprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000")
def expand_edge(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o", "@.totalprice > 300000").expand("o", "contains", opt="edge", alias="e")
    return q.select(o="@o", part="@e.dst", price="@e.price")


@query("SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def expand_degree(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").expand("c", "placed", opt="degree", alias="n").sink("c", "n")


@query("""SELECT l_orderkey AS a, l_suppkey AS b, 'end' AS way FROM lineitem WHERE l_discount >= 0.1 UNION ALL SELECT l_orderkey, l_orderkey, 'start' FROM lineitem WHERE l_discount >= 0.1
    UNION ALL SELECT l_orderkey, l_orderkey, 'both' FROM lineitem WHERE l_discount >= 0.1 UNION ALL SELECT l_orderkey, l_suppkey, 'both' FROM lineitem WHERE l_discount >= 0.1""")
def get_vertex(spark, sf_dir):
    e = graph_query(spark, sf_dir).scan_edges("suppliedBy", "e", "@.discount >= 0.1")
    one = lambda way: e.get_v("e", way, "v").select(a="@e.src", b="@v").withColumn("way", F.lit(way))
    return one("end").unionAll(one("start")).unionAll(one("both"))


@query("""SELECT s_suppkey AS s, 'Order' AS label, l_orderkey AS o FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_acctbal > 9000
    UNION ALL SELECT s_suppkey, 'Nation', s_nationkey FROM supplier WHERE s_acctbal > 9000""")
def get_vertex_other(spark, sf_dir):
    """Of the edges of two relations, one of either direction; ids of suppliers, orders and nations overlap."""
    s = graph_query(spark, sf_dir).scan("Supplier", "s", "@.acctbal > 9000")
    q = s.expand("s", ["suppliedBy", "supplierIn"], "both", "edge", "e").get_v("e", "other", "o")
    return q.select(s="@s", label="@o.~label", o="@o")


@query("""SELECT l_orderkey AS a, concat_ws('-', l_orderkey, l_suppkey) AS path FROM lineitem
    UNION ALL SELECT l_orderkey, concat_ws('-', l_orderkey, l_suppkey, s_nationkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def path_arbitrary(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").path_expand(1, 3, "o", ["suppliedBy", "supplierIn"], alias="p")
    return q.sink("o", "p").select(F.col("o").alias("a"), F.array_join(F.col("p").cast("array<string>"), "-").alias("path"))


@query("""SELECT cast(s_suppkey AS bigint) AS a, 'Supplier' AS label, cast(s_suppkey AS varchar) AS path FROM supplier UNION ALL SELECT s_suppkey, 'Nation', concat_ws('-', s_suppkey, s_nationkey) FROM supplier
    UNION ALL SELECT a.s_suppkey, 'Supplier', concat_ws('-', a.s_suppkey, a.s_nationkey, b.s_suppkey) FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey""")
def path_simple(spark, sf_dir):
    """Ids of suppliers and nations overlap: a path from one to the other with the same id is simple."""
    q = graph_query(spark, sf_dir).scan("Supplier", "s").path_expand(0, 3, "s", "supplierIn", "both", path="simple", alias="p")
    return q.project({"a": "@s", "label": "@p.~label", "p": "@p"}).df.select("a", "label", F.array_join(F.col("p").cast("array<string>"), "-").alias("path"))


@query("""SELECT cast(s_suppkey AS bigint) AS a, cast(s_nationkey AS bigint) AS e, 'Nation' AS label, 1 AS hops, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT a.s_suppkey, b.s_suppkey, 'Supplier', 2, count(*) FROM supplier a JOIN supplier b USING (s_nationkey) GROUP BY ALL""")
def path_ends(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Supplier", "s").path_expand(1, 3, "s", "supplierIn", "both", result="end_v", alias="p")
    return q.group_by({"a": "@s", "e": "@p.~id", "label": "@p.~label", "hops": "@p.~len"}, {"n": ("count",)}).df


@query("""SELECT a.l_orderkey AS o, a.l_suppkey AS s, b.l_partkey AS p, count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey
    JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) u ON u.l_suppkey = a.l_suppkey AND u.l_partkey = b.l_partkey WHERE a.l_quantity > 48 GROUP BY ALL""")
def intersect_bag(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").expand("o", "suppliedBy", alias="s", predicate="@.quantity > 48")
    q = q.intersect([("o", "contains", "out"), ("s", "supplies", "out")], "p")
    return q.group_by({"o": "@o", "s": "@s", "p": "@p"}, {"n": ("count",)}).df


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b USING (l_orderkey)
    JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) c USING (l_suppkey, l_partkey)""")
def intersect_set(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o")
    e = q.graph.edges("suppliedBy").select(F.col("src").alias("o__id"), F.col("dst").alias("s__id")).distinct().withColumns({"o__label": F.lit("Order"), "s__label": F.lit("Supplier")})
    pairs = GraphQuery(q.graph, e, {"o": ("vertex", ("Order",)), "s": ("vertex", ("Supplier",))}, "s")
    return pairs.intersect([("o", "contains", "out"), ("s", "supplies", "out")], "p", distinct_edges=True).group_by({}, {"n": ("count",)}).df


@query("""SELECT count(*) AS bag, count(DISTINCT (c_custkey, o_orderkey, s_suppkey)) AS dist FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def edge_check(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").expand("c", "placed", alias="o").expand("o", "suppliedBy", alias="s").expand("s", "supplierIn", alias="n").edge_check("c", "n", "customerIn")
    return q.group_by({}, {"bag": ("count",), "dist": ("count_distinct", "@c", "@o", "@s")}).df


@query("SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY c_custkey")
def apply_count(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o").where("@o.totalprice > 250000"), "inner", "n", agg=("count",))
    return q.sink("c", "n")


@query("SELECT c_custkey AS c, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def apply_left(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o"), "left", "m", agg=("max", "@o.totalprice")).sink("c", "m")


@query("SELECT c_custkey AS c, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def apply_first(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o").fetch("o", "orderdate"), "inner", "first_order", first=("@o.orderdate", "@o"))
    return q.sink("c", "first_order")


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def apply_semi(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o").where('@o.status == "P"'), "semi").sink("c")


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def apply_anti(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o").where("@o.totalprice > 300000"), "anti").sink("c")


@query("SELECT o_orderkey AS ord, o_orderpriority AS priority FROM orders WHERE o_orderpriority LIKE '1%'")
def auxilia(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").expand("c", "placed", alias="o").auxilia("o", ("priority",), '@.priority startswith "1"', alias="ord", drop=("c",))
    return q.select(ord="@ord", priority="@ord.priority")


# --- relational operators -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS o, round(o_totalprice * 2, 2) AS twice, o_orderstatus AS status FROM orders WHERE o_totalprice < 50000")
def project_append(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").where("@o.totalprice < 50000").project({"twice": "@o.totalprice * 2"}, append=True)
    return q.select(o="@o", twice="@twice", status="@o.status").withColumn("twice", F.round("twice", 2))


@query("SELECT count(*) AS n FROM (SELECT max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE m IS NOT NULL")
def project_single_drops(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o"), "left", "m", agg=("max", "@o.totalprice"))
    return q.project({"m": "@m"}).group_by({}, {"n": ("count",)}).df


def _joined(kind: str):
    def run(spark, sf_dir):
        g = graph_query(spark, sf_dir)
        left = g.scan("Customer", "c").where("@c.acctbal > 8000").project({"k": "@c.nationkey", "c": "@c"})
        right = g.scan_table(read(spark, sf_dir, "supplier").where("s_acctbal > 6000").selectExpr("s_nationkey AS k", "s_suppkey AS s"))
        out = left.join(right, ["k"], kind).df
        return out.select("c") if kind in ("semi", "anti") else out.select("c", "s", "k")

    run.__name__ = f"join_{kind}"
    return run


_L = "(SELECT c_nationkey AS k, c_custkey AS c FROM customer WHERE c_acctbal > 8000) l"
_R = "(SELECT s_nationkey AS k, s_suppkey AS s FROM supplier WHERE s_acctbal > 6000) r"
for _kind, _sql in {
    "inner": f"SELECT c, s, k FROM {_L} JOIN {_R} USING (k)",
    "left": f"SELECT c, s, k FROM {_L} LEFT JOIN {_R} USING (k)",
    "right": f"SELECT c, s, k FROM {_L} RIGHT JOIN {_R} USING (k)",
    "full": f"SELECT c, s, k FROM {_L} FULL JOIN {_R} USING (k)",
    "semi": f"SELECT c FROM {_L} SEMI JOIN {_R} USING (k)",
    "anti": f"SELECT c FROM {_L} ANTI JOIN {_R} USING (k)",
}.items():
    query(_sql)(_joined(_kind))


@query("SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
def join_times(spark, sf_dir):
    g = graph_query(spark, sf_dir)
    return g.scan("Region", "x").project({"r": "@x.name"}).join(g.scan("Nation", "y").project({"n": "@y.name"}), kind="times").df


@query("""WITH a AS (SELECT c_custkey AS x, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS k FROM customer), b AS (SELECT s_suppkey AS y, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS k FROM supplier)
    SELECT x, y FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_keys(spark, sf_dir):
    g = graph_query(spark, sf_dir)
    a = g.scan_table(read(spark, sf_dir, "customer").selectExpr("c_custkey AS x", "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS k"))
    b = g.scan_table(read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS y", "CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS k"))
    return a.join(b, ["k"], null_safe=True).df.select("x", "y")


@query("SELECT name, count(*) AS n FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT c_mktsegment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT n_name FROM nation) GROUP BY name")
def union_bag(spark, sf_dir):
    g = graph_query(spark, sf_dir)
    a = g.scan("Customer", "c").project({"name": "@c.segment"})
    b = g.scan("Customer", "c").where("@c.acctbal > 0").project({"name": "@c.segment"})
    return a.union(b, g.scan("Nation", "n").project({"name": "@n.name"})).group_by({"name": "@name"}, {"n": ("count",)}).df


@query("""SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean,
    round(sum(o_totalprice), 2) AS total, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states, len(list(o_orderstatus)) AS listed FROM orders GROUP BY o_orderpriority""")
def group_by_keys(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").expand("c", "placed", alias="o").fetch("o", "totalprice", "status", "priority")
    price = "@o.totalprice"
    df = q.group_by({"priority": "@o.priority"}, {"n": ("count", "@o"), "customers": ("count_distinct", "@c"), "least": ("min", price), "most": ("max", price), "mean": ("avg", price), "total": ("sum", price), "states": ("to_set", "@o.status"), "listed": ("to_list", "@o.status")}).df
    return df.withColumns({"mean": F.round("mean", 4), "total": F.round("total", 2), "states": F.array_join("states", ","), "listed": F.size("listed").cast("long")})


@query("SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs FROM orders")
def group_global(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").expand("c", "placed", alias="o").fetch("o", "status")
    return q.group_by({}, {"rows": ("count",), "pairs": ("count_distinct", "@c", "@o.status")}).df


@query("SELECT o_orderkey AS o, o_totalprice AS price, o_orderpriority AS priority FROM orders ORDER BY o_orderpriority DESC, o_totalprice ASC, o_orderkey LIMIT 25")
def order_top_k(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").order_by(("@o.priority", "desc"), ("@o.totalprice", "asc"), "@o", limit=25)
    return q.select(o="@o", price="@o.totalprice", priority="@o.priority")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 17)")
def limit_rows(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Order", "o").limit(17).group_by({}, {"n": ("count",)}).df


@query("SELECT DISTINCT c_nationkey AS k, c_mktsegment AS segment FROM customer")
def dedup_keys(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").dedup("@c.nationkey", "@c.segment").select(k="@c.nationkey", segment="@c.segment")


@query("SELECT c_nationkey AS k, arg_min(c_custkey, (c_acctbal, c_custkey)) AS c FROM customer GROUP BY c_nationkey")
def dedup_ordered(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Customer", "c").dedup("@c.nationkey", order=("@c.acctbal", "@c")).select(k="@c.nationkey", c="@c")


@query("SELECT c_nationkey AS k, c_custkey AS c FROM customer WHERE c_acctbal > 9000")
def unfold(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c", "@.acctbal > 9000").group_by({"k": "@c.nationkey"}, {"all": ("to_list", "@c")})
    return q.unfold("all", "c").df.select("k", "c")


@query("SELECT c_nationkey AS k, median(c_acctbal) AS mid FROM customer GROUP BY c_nationkey")
def segment_apply(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan_table(read(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "c_acctbal AS b"))
    return q.segment_apply(("@k",), lambda frame: frame.groupby("k", as_index=False).agg(mid=("b", "median")), "k int, mid double").df


# --- expressions ----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS p, (p_partkey + 7) * 3 - p_partkey // 4 AS a, p_partkey % 7 AS b, p_size // 3 AS c, cast(-p_size AS integer) AS d, round(p_retailprice / 4, 6) AS e FROM part")
def expr_arithmetic(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Part", "p").fetch("p", "size", "retailprice")
    out = q.select(p="@p", a="(@p + 7) * 3 - @p / 4", b="@p % 7", c="@p.size / 3", d="-@p.size", e="@p.retailprice / 4")
    return out.withColumns({"c": F.col("c").cast("int"), "e": F.round("e", 6)})


@query("SELECT p_partkey AS p, (p_partkey & 12) + (p_partkey | 3) AS a, xor(p_partkey, 5) AS b, (p_partkey % 1000) << 2 AS c, p_partkey >> 1 AS d FROM part")
def expr_bits(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").select(p="@p", a="@p & 12 + @p | 3", b="@p ^ 5", c="(@p % 1000) << 2", d="@p >> 1")


@query("""SELECT p_partkey AS p, cast(p_size * p_size AS bigint) AS square, round(1.0 / p_size, 9) AS inverse, 4052555153018976267 AS exact,
    cast(list_reduce(list_concat([1::bigint], list_transform(range(p_size % 20), lambda i: 7::bigint)), lambda x, y: x * y) AS bigint) AS by_column FROM part""")
def expr_power(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").select(p="@p", square="@p.size ^^ 2", inverse="@p.size ^^ -1", exact="3 ^^ 39", by_column="7 ^^ (@p.size % 20)").withColumn("inverse", F.round("inverse", 9))


@query("SELECT p_partkey AS p FROM part WHERE (p_size < 10 OR NOT p_retailprice > 1000) AND p_size <> 3 AND p_size >= 2 AND p_size <= 45")
def expr_logic(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").where("(@p.size < 10 || !(@p.retailprice > 1000)) && @p.size != 3 && @p.size >= 2 && @p.size <= 45").sink("p")


@query("SELECT p_partkey AS p FROM part WHERE p_size IN (1, 2, 3) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def expr_within(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").where('@p.size within [1, 2, 3] && @p.brand without ["Brand#11", "Brand#12"]').sink("p")


@query("SELECT p_partkey AS p FROM part WHERE starts_with(p_brand, 'Brand#1') AND suffix(p_type, 'L')")
def expr_strings(spark, sf_dir):
    return graph_query(spark, sf_dir).scan("Part", "p").where('@p.brand startswith "Brand#1" && @p.type endswith "L"').sink("p")


@query("SELECT o_orderkey AS o, concat(o_orderstatus, '/', o_orderpriority) AS pair FROM orders")
def expr_collections(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Order", "o").project({"o": "@o", "list": "[@o.status, @o.priority]", "map": "{@o.status, @o.priority}"})
    return q.df.select("o", F.concat(F.col("list")[0], F.lit("/"), F.col("map")["o.priority"]).alias("pair"))


@query("SELECT count(*) AS kept, (SELECT count(*) FROM customer) AS all_rows FROM (SELECT c_custkey, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE m IS NOT NULL AND NOT m > 200000")
def expr_missing(spark, sf_dir):
    q = graph_query(spark, sf_dir).scan("Customer", "c").apply(lambda x: x.expand("c", "placed", alias="o"), "left", "m", agg=("max", "@o.totalprice"))
    kept = q.where("@m && !(@m > 200000)").group_by({}, {"kept": ("count",)}).df
    return kept.crossJoin(q.group_by({}, {"all_rows": ("count",)}).df)


# --- patterns and plans ---------------------------------------------------------------------------------------------

CYCLE = [("c", "placed", "o"), ("o", "suppliedBy", "s"), ("s", "supplierIn", "n"), ("c", "customerIn", "n")]
CYCLE_SQL = """FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey"""


@query(f"SELECT c_custkey AS c, o_orderkey AS o, s_suppkey AS s, cast(c_nationkey AS bigint) AS n {CYCLE_SQL}")
def match_cycle(spark, sf_dir):
    return graph_query(spark, sf_dir).match(CYCLE).sink("c", "o", "s", "n")


def cycle_query() -> QueryGraph:
    labels = {"c": "Customer", "o": "Order", "s": "Supplier", "n": "Nation"}
    return QueryGraph({a: Vertex(a, x) for a, x in labels.items()}, [Link(s, d, r) for s, r, d in CYCLE])


def cycle_catalogue(graph) -> Catalogue:
    p = Pattern.of({0: "Customer", 1: "Order", 2: "Supplier", 3: "Nation"}, [(0, 1, "placed"), (1, 2, "suppliedBy"), (2, 3, "supplierIn"), (0, 3, "customerIn")])
    return Catalogue.from_patterns(graph, [p], 2)


@query(f"SELECT DISTINCT c_custkey AS c, o_orderkey AS o, s_suppkey AS s, cast(c_nationkey AS bigint) AS n {CYCLE_SQL}")
def plan_cycle_set(spark, sf_dir):
    graph, q = order_graph(spark, sf_dir), cycle_query()
    plan = Planner(q, cycle_catalogue(graph)).best()
    df = executed(plan, graph, q, distinct=True)
    return df.select(*[F.col(f"{x}__id").alias(x) for x in "cosn"])


@query(f"SELECT count(*) AS n {CYCLE_SQL}")
def plan_pattern_hybrid(spark, sf_dir):
    graph = order_graph(spark, sf_dir)
    p = Pattern.of({0: "Customer", 1: "Order", 2: "Supplier", 3: "Nation"}, [(0, 1, "placed"), (1, 2, "suppliedBy"), (2, 3, "supplierIn"), (0, 3, "customerIn")])
    plan = PatternPlanner(p, cycle_catalogue(graph), "hybrid").best()
    return executed(plan, graph, query_graph(p)).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM {KNOWS} a JOIN {KNOWS} b ON b.src = a.dst JOIN {KNOWS} c ON c.src = b.dst AND c.dst = a.src")
def match_triangle(spark, sf_dir):
    q = graph_query(spark, sf_dir).match([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a")])
    return q.group_by({}, {"n": ("count",)}).df


@query(f"""SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) OR c_custkey IN (SELECT src FROM {KNOWS}) AND NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_acctbal < 5000)""")
def match_anti(spark, sf_dir):
    g = graph_query(spark, sf_dir)
    none = g.match([("c", "placed", "o"), ("o", "contains", "p", "anti")]).sink("c", "o")
    poor = g.match([("c", "placed", "o"), ("c", "knows", "d", "semi"), ("o", "suppliedBy", "s", "anti")], predicates={"s": "@s.acctbal < 5000"}).sink("c", "o")
    return none.unionAll(poor).distinct()


@query("""SELECT p_partkey AS p, min(s_name) AS least_supplier, count(*) AS n FROM orders JOIN lineitem lp ON lp.l_orderkey = o_orderkey JOIN part ON p_partkey = lp.l_partkey JOIN lineitem ls ON ls.l_orderkey = o_orderkey AND ls.l_linenumber = lp.l_linenumber JOIN supplier ON s_suppkey = ls.l_suppkey
    JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 5000 AND p_size < 5 GROUP BY p_partkey""")
def plan_join_template(spark, sf_dir):
    """A star of an order with its customer, part and supplier; line numbers keep an order's lines apart."""
    graph = order_graph(spark, sf_dir)
    vertices = {"o": Vertex("o", "Order", selectivity=0.2, predicate="priority = '1-URGENT'"), "c": Vertex("c", "Customer", selectivity=0.5, predicate="acctbal > 5000"), "p": Vertex("p", "Part", selectivity=0.1, predicate="size < 5"), "s": Vertex("s", "Supplier")}
    q = QueryGraph(vertices, [Link("c", "o", "placed"), Link("o", "p", "contains", alias="lp"), Link("o", "s", "suppliedBy", alias="ls")])
    star = Pattern.of({0: "Order", 1: "Customer", 2: "Part", 3: "Supplier"}, [(1, 0, "placed"), (0, 2, "contains"), (0, 3, "suppliedBy")])
    planner = Planner(q, Catalogue.from_patterns(graph, [star], 2))
    plan = planner.left_deep(JoinPlanner(planner).order())
    df = executed(plan, graph, q, {"s": ["name"], "lp": ["line"], "ls": ["line"]}).where("lp__line = ls__line")
    return df.groupBy(F.col("p__id").alias("p")).agg(F.min("s__name").alias("least_supplier"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS c, event_type, count(*) AS n, min(n_name) AS nation FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE event_type <> 'view' GROUP BY ALL")
def plan_interleaved(spark, sf_dir):
    """A graph side (customer in nation), an identity to a second customer alias, and a plain table with a fanout."""
    graph = order_graph(spark, sf_dir)
    vertices = {"a": Vertex("a", "Customer"), "n": Vertex("n", "Nation"), "x": Vertex("x", "Customer", "sql"), "ev": Vertex("ev", None, "sql", fanout=5.0, predicate="event_type <> 'view'", table="events")}
    q = QueryGraph(vertices, [Link("a", "n", "customerIn"), Link("a", "x", identity=True), Link("x", "ev", on=(("id", "user_id"),))])
    p = Pattern.of({0: "Customer", 1: "Nation"}, [(0, 1, "customerIn")])
    plan = Planner(q, Catalogue.from_patterns(graph, [p], 2)).best()
    df = executed(plan, graph, q, {"n": ["name"]}, {"events": read(spark, sf_dir, "events")})
    return df.groupBy(F.col("x__id").alias("c"), F.col("ev__event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.min("n__name").alias("nation"))


@query("""SELECT r_name AS region, min(c_name) AS least_customer, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey WHERE s_acctbal > 5000 AND o_orderstatus = 'P' GROUP BY r_name""")
def plan_join_chain(spark, sf_dir):
    graph = order_graph(spark, sf_dir)
    vertices = {"r": Vertex("r", "Region"), "n": Vertex("n", "Nation"), "s": Vertex("s", "Supplier", selectivity=0.5, predicate="acctbal > 5000"), "o": Vertex("o", "Order", selectivity=0.03, predicate="status = 'P'"), "c": Vertex("c", "Customer")}
    q = QueryGraph(vertices, [Link("n", "r", "partOf"), Link("s", "n", "supplierIn"), Link("o", "s", "suppliedBy"), Link("c", "o", "placed")])
    chain = Pattern.of({0: "Customer", 1: "Order", 2: "Supplier", 3: "Nation", 4: "Region"}, [(0, 1, "placed"), (1, 2, "suppliedBy"), (2, 3, "supplierIn"), (3, 4, "partOf")])
    planner = Planner(q, Catalogue.from_patterns(graph, [chain], 2))
    df = executed(planner.left_deep(JoinPlanner(planner).order()), graph, q, {"r": ["name"], "c": ["name"]})
    return df.groupBy(F.col("r__name").alias("region")).agg(F.min("c__name").alias("least_customer"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS c, count(*) AS n, max(p1.p_retailprice) AS most FROM customer JOIN orders a ON a.o_custkey = c_custkey JOIN orders b ON b.o_custkey = c_custkey AND b.o_orderkey > a.o_orderkey
    JOIN lineitem x ON x.l_orderkey = a.o_orderkey JOIN part p1 ON p1.p_partkey = x.l_partkey JOIN lineitem y ON y.l_orderkey = b.o_orderkey JOIN part p2 ON p2.p_partkey = y.l_partkey
    WHERE p1.p_size = 1 AND p2.p_size = 2 AND a.o_orderpriority = '1-URGENT' GROUP BY c_custkey""")
def plan_two_stars(spark, sf_dir):
    """Two orders of a customer, each with a star of its own: a bushy candidate."""
    graph = order_graph(spark, sf_dir)
    vertices = {"c": Vertex("c", "Customer"), "a": Vertex("a", "Order", selectivity=0.2, predicate="priority = '1-URGENT'"), "b": Vertex("b", "Order"), "p": Vertex("p", "Part", selectivity=0.02, predicate="size = 1"), "q": Vertex("q", "Part", selectivity=0.02, predicate="size = 2")}
    q = QueryGraph(vertices, [Link("c", "a", "placed"), Link("c", "b", "placed"), Link("a", "p", "contains"), Link("b", "q", "contains")])
    half = Pattern.of({0: "Customer", 1: "Order", 2: "Part"}, [(0, 1, "placed"), (1, 2, "contains")])
    plan = Planner(q, Catalogue.from_patterns(graph, [half], 3)).best()
    df = executed(plan, graph, q, {"p": ["retailprice"]}).where("b__id > a__id")
    return df.groupBy(F.col("c__id").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("p__retailprice").alias("most"))


@query(f"""WITH k AS {KNOWS}, w AS (SELECT src AS a, dst AS b, 1 AS distance FROM k UNION ALL SELECT x.src, y.dst, 2 FROM k x JOIN k y ON y.src = x.dst)
    SELECT a, distance, count(*) AS n FROM w JOIN orders ON o_custkey = b GROUP BY a, distance""")
def plan_fixed_hops(spark, sf_dir):
    """A variable-length edge of a pattern file: one fixed pattern per number of hops, planned and executed each, and their union."""
    graph = order_graph(spark, sf_dir)
    v = lambda tag, alias, label: {"tag_id": tag, "alias": alias, "label": label, "label_id": 0}
    e = lambda i, name, s, d, lo, hi: {"edge_id": i, "alias": None, "type": name, "relation_id": i, "relation_label": name, "source_tag": s, "target_tag": d, "min_hops": lo, "max_hops": hi, "is_var_expand": lo != hi, "is_identity": False, "is_reversed": False}
    data = {"query": "hops", "match": {"vertices": [v(0, "a", "Customer"), v(1, "b", "Customer"), v(2, "m", "Order")], "edges": [e(0, "knows", 0, 1, 1, 2), e(1, "placed", 1, 2, 1, 1)]}, "sql": {"vertices": [], "edges": []}, "alias_domains": {"a": "match", "b": "match", "m": "match"}}
    path = Pattern.of({0: "Customer", 1: "Customer", 2: "Order"}, [(0, 1, "knows"), (1, 2, "placed")])
    catalogue, parts = Catalogue.from_patterns(graph, [path], 2), []
    for hops in (1, 2):
        q = QueryGraph.from_json(fixed_hops(data, hops))
        df = executed(Planner(q, catalogue).best(), graph, q)
        parts.append(df.groupBy(F.col("a__id").alias("a")).agg(F.count(F.lit(1)).alias("n")).withColumn("distance", F.lit(hops)))
    return parts[0].unionByName(parts[1])


# --- statistics -----------------------------------------------------------------------------------------------------


@query(f"""SELECT 'Customer-placed-Order' AS what, count(*) AS rows FROM orders UNION ALL SELECT 'Order-contains-Part', count(*) FROM lineitem UNION ALL SELECT 'Order-suppliedBy-Supplier', count(*) FROM lineitem
    UNION ALL SELECT 'Supplier-supplies-Part', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem UNION ALL SELECT 'Customer-customerIn-Nation', count(*) FROM customer
    UNION ALL SELECT 'Supplier-supplierIn-Nation', count(*) FROM supplier UNION ALL SELECT 'Nation-partOf-Region', count(*) FROM nation UNION ALL SELECT 'Customer-knows-Customer', count(*) FROM {KNOWS}""")
def graph_statistics(spark, sf_dir):
    return aggregated(order_graph(spark, sf_dir)).where("kind = 'edge'").select(F.concat_ws("-", "src_label", "label", "dst_label").alias("what"), "rows")


@query("SELECT count(*) AS n FROM orders a JOIN lineitem l ON l.l_orderkey = a.o_orderkey JOIN supplier ON s_suppkey = l_suppkey")
def pattern_count(spark, sf_dir):
    p = Pattern.of({0: "Customer", 1: "Order", 2: "Supplier"}, [(0, 1, "placed"), (1, 2, "suppliedBy")])
    n = counted(order_graph(spark, sf_dir), p)
    return spark.createDataFrame([(int(n),)], "n long")


@query("SELECT 'big' AS name, cast(count_if(o_totalprice > 100000) AS bigint) AS matched, count(*) AS total FROM orders UNION ALL SELECT 'open', cast(count_if(o_orderstatus = 'O') AS bigint), count(*) FROM orders UNION ALL SELECT 'combined', cast(count_if(o_totalprice > 100000 AND o_orderstatus = 'O') AS bigint), count(*) FROM orders")
def predicate_selectivity(spark, sf_dir):
    found = selectivities(read(spark, sf_dir, "orders"), {"big": "o_totalprice > 100000", "open": "o_orderstatus = 'O'"})
    return spark.createDataFrame([(k, v["matched_rows"], v["total_rows"]) for k, v in found.items()], "name string, matched long, total long")


# --- streams and iteration ------------------------------------------------------------------------------------------


@query("SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY word")
def word_count(spark, sf_dir):
    return iterate.word_count(read(spark, sf_dir, "part"), "p_name")


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events WHERE value > 1 GROUP BY user_id, event_type")
def stream_fold_by_key(spark, sf_dir):
    return Stream(read(spark, sf_dir, "events")).filter("value > 1").key_by("user_id", "event_type").fold_by_key(n="count(*)", most="max(value)").df


@query("SELECT a.event_id, b.o_orderkey FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) b USING (r)")
def stream_zip(spark, sf_dir):
    a, b = (Stream(read(spark, sf_dir, t).select(c)) for t, c in (("events", "event_id"), ("orders", "o_orderkey")))
    return a.zip(b, ("event_id",), ("o_orderkey",)).df


@query("SELECT user_id, count(*) AS n, cast(count_if(event_type = 'click') AS bigint) AS clicks FROM events GROUP BY user_id UNION ALL SELECT -1, count(*), 0 FROM events WHERE value > 50 OR value IS NULL")
def stream_branch_merge(spark, sf_dir):
    s = Stream(read(spark, sf_dir, "events"))
    high, _ = s.branch("value > 50")
    rows = s.key_by("user_id").fold_by_key(n="count(*)", clicks="count_if(event_type = 'click')")
    return rows.merge(high.fold(user_id="cast(-1 as bigint)", n="count(*)", clicks="cast(0 as bigint)")).df


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS c, cast(c_custkey AS bigint) AS x, 0 AS t FROM customer UNION ALL SELECT c, x * 2, t + 1 FROM r WHERE t < 8 AND (t = 0 OR x <= 5000))
    SELECT c, max(x) AS x FROM r GROUP BY c""")
def iterate_until(spark, sf_dir):
    start = read(spark, sf_dir, "customer").selectExpr("c_custkey AS c", "c_custkey AS x")
    return iterate.iterate_until(start, lambda d: d.withColumn("x", F.col("x") * 2), "x > 5000", 8)


_RANK = """{name} AS (SELECT ids.id, 0.15 + 0.85 * coalesce(sum(p.part * r.rank), 0) AS rank FROM ids LEFT JOIN parts p ON p.dst = ids.id LEFT JOIN {prev} r ON r.id = p.src GROUP BY ids.id)"""


@query(f"""WITH k AS {KNOWS}, deg AS (SELECT src, count(*) AS d FROM k GROUP BY src), parts AS (SELECT src, dst, count(*) * 1.0::double / any_value(d) AS part FROM k JOIN deg USING (src) GROUP BY src, dst), ids AS (SELECT DISTINCT src AS id FROM k UNION SELECT DISTINCT dst FROM k),
    r0 AS (SELECT id, 1.0::double AS rank FROM ids), {_RANK.format(name="r1", prev="r0")}, {_RANK.format(name="r2", prev="r1")}, {_RANK.format(name="r3", prev="r2")}
    SELECT id, round(rank, 6) AS rank FROM r3""")
def page_rank(spark, sf_dir):
    return iterate.page_rank(order_graph(spark, sf_dir).edges("knows"), 3).withColumn("rank", F.round("rank", 6))


@query(f"""WITH k AS {KNOWS}, w AS (SELECT 1::bigint AS source, 1::bigint AS id, 0 AS distance UNION ALL SELECT 20, 20, 0 UNION ALL SELECT src, dst, 1 FROM k WHERE src IN (1, 20) UNION ALL SELECT a.src, b.dst, 2 FROM k a JOIN k b ON b.src = a.dst WHERE a.src IN (1, 20))
    SELECT source, id, min(distance) AS distance FROM w GROUP BY source, id""")
def k_hop(spark, sf_dir):
    sources = spark.createDataFrame([(1,), (20,)], "source long")
    return iterate.k_hop(order_graph(spark, sf_dir), sources, "knows", 2)


@query(f"""WITH RECURSIVE k AS {KNOWS}, r AS (SELECT 1::bigint AS id UNION SELECT dst FROM r JOIN k ON src = r.id) SELECT id FROM r""")
def closure(spark, sf_dir):
    return iterate.closure(order_graph(spark, sf_dir).edges("knows"), spark.createDataFrame([(1,)], "id long")).select("id")
