"""Twelve interactive queries over the order graph, after the texts of a social-network workload.

Customers stand for persons, `knows` joins those of a nation and segment, orders stand for messages, parts for tags, nations for cities and regions for countries. The texts' peculiarities
are kept: a "new" part survives if some earlier order of a friend lacks it (4), every walk length counts for itself (1), and orders without a line go (10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import closure
from ..operators.query import GraphQuery
from ..sources.graph import order_graph
from .operators import KNOWS

QUERIES: dict = {}
SQL: dict[str, str] = {}
PERSON = 13
START, END = "1995-01-01", "1997-01-01"


def query(sql: str):
    def registered(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return registered


def friends(g: GraphQuery, lo: int, hi: int, start: int = PERSON) -> GraphQuery:
    """Tag b: ends of walks of lo to hi hops from the person; tag distance: their lengths. One branch per length."""
    parts = []
    for hops in range(lo, hi + 1):
        q = g.scan("Customer", "a", ids=[start])
        for k in range(hops):
            q = q.expand(None if k else "a", "knows", alias="b" if k == hops - 1 else f"m{k}")
        parts.append(q.drop(*[f"m{k}" for k in range(hops - 1)]).project({"distance": F.lit(hops)}, append=True))
    return parts[0].union(*parts[1:])


def walks(lo: int, hi: int) -> str:
    """SQL of the same: columns b and distance."""
    sql = []
    for hops in range(lo, hi + 1):
        joins = " ".join(f"JOIN k k{i} ON k{i}.src = k{i - 1}.dst" for i in range(1, hops))
        sql.append(f"SELECT k{hops - 1}.dst AS b, {hops} AS distance FROM k k0 {joins} WHERE k0.src = {PERSON}")
    return f"k AS {KNOWS}, w AS ({' UNION ALL '.join(sql)})"


def top(df: DataFrame, n: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(n)


@query(f"""WITH {walks(1, 3)} SELECT b AS id, c_name AS name, distance, min(n_name) AS city, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities,
    array_to_string(list_sort(list(DISTINCT coalesce(s_name, '') || '/' || coalesce(sn.n_name_2, ''))), ',') AS suppliers
    FROM (SELECT DISTINCT b, distance FROM w) JOIN customer ON c_custkey = b JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = b AND o_totalprice > 250000 LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45
    LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT n_nationkey AS nk, n_name AS n_name_2 FROM nation) sn ON sn.nk = s_nationkey
    WHERE b <> {PERSON} AND c_acctbal > 1000 GROUP BY b, c_name, distance ORDER BY distance, c_name, b LIMIT 20""")
def ic_1(spark, sf_dir):
    g = GraphQuery(order_graph(spark, sf_dir))
    q = friends(g, 1, 3).where(f"@b != {PERSON} && @b.acctbal > 1000").dedup("@b", "@distance").expand("b", "customerIn", alias="city")
    x = q.select(id="@b", name="@b.name", distance="@distance", city="@city.name")
    orders = g.graph.edges("placed").join(g.graph.vertices("Order").where("totalprice > 250000"), F.col("dst") == F.col("id")).select(F.col("src").alias("id"), F.col("dst").alias("o"), "priority")
    lines = g.graph.edges("suppliedBy").where("quantity > 45").select(F.col("src").alias("o"), F.col("dst").alias("s"))
    s = g.scan("Supplier", "s").expand("s", "supplierIn", alias="n").select(s="@s", supplier="@s.name", nation="@n.name")
    x = x.join(orders, "id", "left").join(lines, "o", "left").join(s, "s", "left")
    pair = F.concat(F.coalesce("supplier", F.lit("")), F.lit("/"), F.coalesce("nation", F.lit("")))
    joined = lambda c: F.when(F.count(c) > 0, F.array_join(F.sort_array(F.collect_set(c)), ","))
    rows = x.groupBy("id", "name", "distance").agg(F.min("city").alias("city"), joined(F.col("priority")).alias("priorities"), joined(pair).alias("suppliers"))
    return top(rows, 20, "distance", "name", "id")


@query(f"""WITH k AS {KNOWS} SELECT c_custkey AS person, c_name AS name, o_orderkey AS message, coalesce(o_orderpriority, o_orderstatus) AS content, o_orderdate AS made
    FROM k JOIN customer ON c_custkey = dst JOIN orders ON o_custkey = dst WHERE src = {PERSON} AND o_orderdate < TIMESTAMP '{END}' ORDER BY made DESC, message LIMIT 20""")
def ic_2(spark, sf_dir):
    q = GraphQuery(order_graph(spark, sf_dir)).scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="b").expand("b", "placed", alias="c")
    q = q.fetch("c", "orderdate", "priority", "status").where(F.col("c__orderdate") < F.lit(END).cast("timestamp"))
    q = q.order_by(("@c.orderdate", "desc"), "@c", limit=20)
    return q.select(person="@b", name="@b.name", message="@c", content=F.coalesce("c__priority", "c__status"), made="@c.orderdate")


@query(f"""WITH {walks(1, 2)}, x AS (SELECT b, c_name, o_orderkey, r2.r_name AS there FROM w JOIN customer ON c_custkey = b JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN region r1 ON r1.r_regionkey = n1.n_regionkey
      JOIN orders ON o_custkey = b JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON n2.n_nationkey = s_nationkey JOIN region r2 ON r2.r_regionkey = n2.n_regionkey
      WHERE o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '{END}' AND r2.r_name IN ('AFRICA', 'AMERICA') AND r1.r_name NOT IN ('AFRICA', 'AMERICA'))
    SELECT b AS id, c_name AS name, count(DISTINCT CASE WHEN there = 'AFRICA' THEN o_orderkey END) AS x_count, count(DISTINCT CASE WHEN there = 'AMERICA' THEN o_orderkey END) AS y_count, count(DISTINCT o_orderkey) AS all_count
    FROM x GROUP BY b, c_name HAVING x_count > 0 AND y_count > 0 ORDER BY all_count DESC, id LIMIT 20""")
def ic_3(spark, sf_dir):
    q = friends(GraphQuery(order_graph(spark, sf_dir)), 1, 2).expand("b", "placed", alias="e").fetch("e", "orderdate")
    q = q.where((F.col("e__orderdate") >= F.lit(START).cast("timestamp")) & (F.col("e__orderdate") < F.lit(END).cast("timestamp")))
    q = q.expand("b", "customerIn", alias="c").expand("c", "partOf", alias="d").where('@d.name without ["AFRICA", "AMERICA"]')
    q = q.expand("e", "suppliedBy", alias="s").expand("s", "supplierIn", alias="f").expand("f", "partOf", alias="g").where('@g.name within ["AFRICA", "AMERICA"]').fetch("b", "name")
    n = lambda r: ("count_distinct", F.when(F.col("g__name") == r, F.col("e__id")))
    q = q.group_by({"id": "@b", "name": "@b.name"}, {"x_count": n("AFRICA"), "y_count": n("AMERICA"), "all_count": ("count_distinct", "@e")}).where("@x_count > 0 && @y_count > 0")
    return top(q.df, 20, F.desc("all_count"), "id")


@query(f"""WITH k AS {KNOWS} SELECT p_name AS name, count(DISTINCT o.o_orderkey) AS posts FROM k JOIN orders o ON o.o_custkey = k.dst JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part ON p_partkey = l.l_partkey
    LEFT JOIN k ke ON ke.src = k.src LEFT JOIN orders f ON f.o_custkey = ke.dst AND f.o_orderdate < TIMESTAMP '{START}' LEFT JOIN lineitem old ON old.l_orderkey = f.o_orderkey AND old.l_partkey = l.l_partkey
    WHERE k.src = {PERSON} AND o.o_orderdate >= TIMESTAMP '{START}' AND o.o_orderdate < TIMESTAMP '{END}' AND old.l_partkey IS NULL GROUP BY p_partkey, p_name ORDER BY posts DESC, name, p_partkey LIMIT 10""")
def ic_4(spark, sf_dir):
    g = GraphQuery(order_graph(spark, sf_dir))
    posts = g.scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="b").expand("b", "placed", alias="c").expand("c", "contains", alias="d").fetch("c", "orderdate").fetch("d", "name")
    posts = posts.where((F.col("c__orderdate") >= F.lit(START).cast("timestamp")) & (F.col("c__orderdate") < F.lit(END).cast("timestamp")))
    # Some earlier order (or no order at all) of a friend lacks the part: counted, not expanded
    old = g.scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="e").expand("e", "placed", alias="f").fetch("f", "orderdate").where(F.col("f__orderdate") < F.lit(START).cast("timestamp"))
    have = old.expand("f", "contains", alias="d").df.groupBy("d__id").agg(F.count_distinct("f__id").alias("have"))
    # A friend with an order that is not earlier, or without any, gives a row without an earlier order
    friend = g.scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="e").apply(lambda x: x.expand("e", "placed", alias="f"), "inner", "n", on="e", agg=("count",))
    late = g.scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="e").expand("e", "placed", alias="f").fetch("f", "orderdate").where(F.col("f__orderdate") >= F.lit(START).cast("timestamp"))
    loose = friend.df.agg(F.count_if(F.col("n") == 0).alias("none")).crossJoin(late.df.agg(F.count(F.lit(1)).alias("late"))).crossJoin(old.df.agg(F.count_distinct("f__id").alias("early")))
    x = posts.df.join(have, "d__id", "left").crossJoin(loose)
    x = x.where((F.col("none") + F.col("late") > 0) | (F.coalesce("have", F.lit(0)) < F.col("early")))
    rows = x.groupBy("d__id", F.col("d__name").alias("name")).agg(F.count_distinct("c__id").alias("posts"))
    return top(rows, 10, F.desc("posts"), "name", "d__id").select("name", "posts")


@query(f"""WITH {walks(1, 2)} SELECT s_name AS title, count(DISTINCT p.o_orderkey) AS posts FROM w JOIN orders p ON p.o_custkey = b JOIN lineitem l ON l.l_orderkey = p.o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN customer ON c_custkey = b JOIN lineitem m ON m.l_suppkey = s_suppkey JOIN orders o2 ON o2.o_orderkey = m.l_orderkey AND o2.o_custkey = b WHERE b <> {PERSON} AND m.l_shipdate > TIMESTAMP '{START}'
    GROUP BY s_suppkey, s_name ORDER BY posts DESC, s_suppkey LIMIT 20""")
def ic_5(spark, sf_dir):
    g = GraphQuery(order_graph(spark, sf_dir))
    q = friends(g, 1, 2).where(f"@b != {PERSON}").dedup("@b").expand("b", "placed", alias="p").expand("p", "suppliedBy", alias="f").fetch("f", "name")
    member = g.scan("Customer", "b").expand("b", "placed", alias="o").expand("o", "suppliedBy", alias="f", edge_alias="e").fetch("b").where(F.col("e__shipdate") > F.lit(START).cast("timestamp"))
    rows = q.df.join(member.df.select("b__id", "f__id").distinct(), ["b__id", "f__id"], "left_semi").groupBy("f__id", F.col("f__name").alias("title")).agg(F.count_distinct("p__id").alias("posts"))
    return top(rows, 20, F.desc("posts"), "f__id").select("title", "posts")


@query(f"""WITH {walks(1, 2)}, tag AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') SELECT p_name AS other, count(DISTINCT o_orderkey) AS posts FROM w JOIN orders ON o_custkey = b JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN part ON p_partkey = l.l_partkey
    JOIN lineitem g ON g.l_orderkey = o_orderkey JOIN tag ON tag.p_partkey = g.l_partkey WHERE b <> {PERSON} AND p_brand <> 'Brand#11' GROUP BY p_name ORDER BY posts DESC, other LIMIT 10""")
def ic_6(spark, sf_dir):
    q = friends(GraphQuery(order_graph(spark, sf_dir)), 1, 2).where(f"@b != {PERSON}").dedup("@b").expand("b", "placed", alias="c")
    q = q.apply(lambda x: x.expand("c", "contains", alias="t").where('@t.brand == "Brand#11"'), "semi", on="c").expand("c", "contains", alias="e").where('@e.brand != "Brand#11"').fetch("e", "name")
    q = q.group_by({"other": "@e.name"}, {"posts": ("count_distinct", "@c")})
    return top(q.df, 10, F.desc("posts"), "other")


@query(f"""SELECT s_suppkey AS friend, s_name AS name, l_shipdate AS liked, o_orderkey AS message, cast(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 60) AS integer) AS latency, FALSE AS is_new
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_custkey = {PERSON} ORDER BY liked DESC, friend, message, latency LIMIT 20""")
def ic_7(spark, sf_dir):
    """A supplier ships (likes) an order of the person: the edge's property, the difference in minutes and a constant."""
    q = GraphQuery(order_graph(spark, sf_dir)).scan("Customer", "a", ids=[PERSON]).expand("a", "placed", alias="b").expand("b", "suppliedBy", alias="c", edge_alias="e").fetch("b", "orderdate").fetch("c", "name")
    minutes = F.floor((F.unix_timestamp("e__shipdate") - F.unix_timestamp("b__orderdate")) / 60).cast("int")
    df = q.select(friend="@c", name="@c.name", liked="@e.shipdate", message="@b", latency=minutes, is_new=F.lit(False))
    return top(df, 20, F.desc("liked"), "friend", "message", "latency")


@query(f"""SELECT s_suppkey AS author, s_name AS name, l_shipdate AS made, l_orderkey AS comment, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE o_custkey = {PERSON} ORDER BY made DESC, comment, line LIMIT 20""")
def ic_8(spark, sf_dir):
    q = GraphQuery(order_graph(spark, sf_dir)).scan("Customer", "a", ids=[PERSON]).expand("a", "placed", alias="b").expand("b", "suppliedBy", opt="edge", alias="c").get_v("c", "end", "d").fetch("d", "name")
    return top(q.select(author="@d", name="@d.name", made="@c.shipdate", comment="@b", line="@c.line"), 20, F.desc("made"), "comment", "line")


@query(f"""WITH {walks(1, 2)} SELECT b AS other, c_name AS name, o_orderkey AS message, CASE WHEN o_orderpriority IS NOT NULL THEN o_orderpriority ELSE o_orderstatus END AS content, o_orderdate AS made, distance
    FROM w JOIN customer ON c_custkey = b JOIN orders ON o_custkey = b WHERE b <> {PERSON} AND o_orderdate < TIMESTAMP '{END}' ORDER BY made DESC, message, distance LIMIT 20""")
def ic_9(spark, sf_dir):
    q = friends(GraphQuery(order_graph(spark, sf_dir)), 1, 2).where(f"@b != {PERSON}").expand("b", "placed", alias="c").fetch("c", "orderdate", "priority", "status").fetch("b", "name")
    q = q.where(F.col("c__orderdate") < F.lit(END).cast("timestamp"))
    content = F.when(F.col("c__priority").isNotNull(), F.col("c__priority")).otherwise(F.col("c__status"))
    return top(q.select(other="@b", name="@b.name", message="@c", content=content, made="@c.orderdate", distance="@distance"), 20, F.desc("made"), "message", "distance")


@query(f"""WITH {walks(2, 2)}, mine AS (SELECT DISTINCT l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = {PERSON}),
    x AS (SELECT l_orderkey AS o, max(CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM lineitem LEFT JOIN mine ON s = l_suppkey GROUP BY l_orderkey)
    SELECT b AS foaf, c_name AS name, cast(sum(CASE WHEN hit = 1 THEN 1 ELSE -1 END) AS bigint) AS score, c_mktsegment AS segment, n_name AS city FROM w JOIN customer ON c_custkey = b JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = b JOIN x ON x.o = o_orderkey
    WHERE b <> {PERSON} AND ((month(o_orderdate) = 3 AND day(o_orderdate) >= 21) OR (month(o_orderdate) = 4 AND day(o_orderdate) < 22)) GROUP BY ALL ORDER BY score DESC, foaf LIMIT 10""")
def ic_10(spark, sf_dir):
    g = GraphQuery(order_graph(spark, sf_dir))
    mine = g.scan("Customer", "m", ids=[PERSON]).expand("m", "placed", alias="o").expand("o", "suppliedBy", alias="s").df.select("s__id").distinct().withColumn("mine", F.lit(1))
    hits = g.graph.edges("suppliedBy").join(mine, F.col("dst") == F.col("s__id"), "left").groupBy(F.col("src").alias("c__id")).agg(F.max(F.coalesce("mine", F.lit(0))).alias("hit"))
    q = friends(g, 2, 2).where(f"@b != {PERSON}").expand("b", "placed", alias="c").expand("b", "customerIn", alias="e").fetch("c", "orderdate").fetch("b", "name", "segment").fetch("e", "name")
    month, day = F.month("c__orderdate"), F.dayofmonth("c__orderdate")
    x = q.df.join(hits, "c__id").where(((month == 3) & (day >= 21)) | ((month == 4) & (day < 22)))
    rows = x.groupBy(F.col("b__id").alias("foaf"), F.col("b__name").alias("name"), F.col("b__segment").alias("segment"), F.col("e__name").alias("city")).agg(F.sum(F.when(F.col("hit") == 1, 1).otherwise(-1)).alias("score"))
    return top(rows, 10, F.desc("score"), "foaf")


@query(f"""WITH {walks(1, 2)} SELECT DISTINCT b AS other, c_name AS name, s_name AS company, l_shipdate AS since FROM w JOIN customer ON c_custkey = b JOIN orders ON o_custkey = b JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE b <> {PERSON} AND r_name = 'ASIA' AND l_shipdate < TIMESTAMP '{END}' ORDER BY since, other, company DESC LIMIT 10""")
def ic_11(spark, sf_dir):
    q = friends(GraphQuery(order_graph(spark, sf_dir)), 1, 2).where(f"@b != {PERSON}").dedup("@b").expand("b", "placed", alias="o").expand("o", "suppliedBy", alias="d", edge_alias="c")
    q = q.where(F.col("c__shipdate") < F.lit(END).cast("timestamp")).expand("d", "supplierIn", alias="n").expand("n", "partOf", alias="e").where('@e.name == "ASIA"').fetch("b", "name").fetch("d", "name")
    return top(q.select(other="@b", name="@b.name", company="@d.name", since="@c.shipdate").distinct(), 10, "since", "other", F.desc("company"))


@query(f"""WITH RECURSIVE k AS {KNOWS}, classes AS (SELECT 0 AS id UNION ALL SELECT n_nationkey + 100 FROM nation, classes WHERE n_regionkey = classes.id AND classes.id < 100)
    SELECT b.c_custkey AS friend, b.c_name AS name, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS tags, count(DISTINCT o_orderkey) AS replies FROM k JOIN customer b ON b.c_custkey = dst JOIN orders ON o_custkey = dst JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN classes ON classes.id = s_nationkey + 100 WHERE src = {PERSON} GROUP BY b.c_custkey, b.c_name HAVING count(DISTINCT o_orderkey) > 0 ORDER BY replies DESC, friend LIMIT 20""")
def ic_12(spark, sf_dir):
    """The class tree is a region (id 0) with its nations (ids from 100); its closure is computed to a fixpoint."""
    g = GraphQuery(order_graph(spark, sf_dir))
    tree = g.graph.edges("partOf").select(F.col("dst").alias("src"), (F.col("src") + 100).alias("dst"))
    classes = closure(tree, spark.createDataFrame([(0,)], "id long")).select((F.col("id") - 100).alias("tc__id"))
    q = g.scan("Customer", "a", ids=[PERSON]).expand("a", "knows", alias="b").expand("b", "placed", alias="c").expand("c", "suppliedBy", alias="e").expand("e", "supplierIn", alias="tc").fetch("b", "name").fetch("e", "name")
    q = q._with(q.df.join(classes, "tc__id", "left_semi")).group_by({"friend": "@b", "name": "@b.name"}, {"tags": ("to_set", "@e.name"), "replies": ("count_distinct", "@c")}).where("@replies > 0")
    return top(q.df.withColumn("tags", F.array_join("tags", ",")), 20, F.desc("replies"), "friend")
