"""Iteration: loops on the driver over DataFrames whose lineage is cut at every turn.

A turn's result is checkpointed to the shared folder (`spark.checkpoint.dir`; on a local master without one a temporary folder is set), so a lost
executor costs tasks and not the loop.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import PropertyGraph


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="weft-"))
    return df.checkpoint()


def iterate(df: DataFrame, body: Callable[[DataFrame], DataFrame], turns: int) -> DataFrame:
    """The body applied `turns` times."""
    for _ in range(turns):
        df = checkpointed(body(df))
    return df


def iterate_until(df: DataFrame, body: Callable[[DataFrame], DataFrame], until: str | Column, turns: int) -> DataFrame:
    """Rows for which `until` holds leave, the others go round; what is left after `turns` leaves as it is. The test follows the body."""
    until = F.coalesce(F.expr(until) if isinstance(until, str) else until, F.lit(False))
    done = []
    for _ in range(turns):
        df = checkpointed(body(df))
        done.append(df.where(until))
        df = df.where(~until)
        if df.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, df])


def iterate_emit(df: DataFrame, body: Callable[[DataFrame], DataFrame], turns: int, until: str | Column | None = None, before: bool = True) -> DataFrame:
    """All rows that enter the body (`before`) or leave it, of every turn; converged rows go round no more."""
    out = [df] if before else []
    for _ in range(turns):
        df = checkpointed(body(df))
        out.append(df)
        if until is not None:
            df = df.where(~F.coalesce(F.expr(until) if isinstance(until, str) else until, F.lit(False)))
        if df.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def word_count(texts: DataFrame, column: str) -> DataFrame:
    words = texts.select(F.explode(F.split(F.lower(column), r"\s+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def page_rank(edges: DataFrame, turns: int = 20, damping: float = 0.85, least: float = 0.0) -> DataFrame:
    """Ranks (id, rank) from edges (src, dst; a bag). Starts at 1; (1 - damping) + damping x what comes in, each vertex giving equal parts along its edges.
    Ends after `turns`, or when no rank moves by more than `least`."""
    # An edge table is read by every turn: made once, and in the order of the join
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = checkpointed(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(degrees, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("part")))
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
    ranks = checkpointed(ids.withColumn("rank", F.lit(1.0)))
    for _ in range(turns):
        given = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("in"))
        new = ranks.join(given, ranks["id"] == given["dst"], "left").select("id", F.col("rank").alias("old"), (F.lit(1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = checkpointed(new)
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] if least else None
        ranks = new.select("id", "rank")
        if moved is not None and moved <= least:
            break
    return ranks


def k_hop(graph: PropertyGraph, sources: DataFrame, relation: str, hops: int, direction: str = "out") -> DataFrame:
    """(source, id, distance): vertices within `hops` of each source, with their smallest distance. `sources` has column source. The
    frontier is deduplicated at every hop, so walks do not multiply."""
    e = graph.edges([relation]).select("src", "dst")
    e = {"out": e, "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": e.unionAll(e.select(F.col("dst"), F.col("src")))}[direction].distinct()
    seen = sources.select("source", F.col("source").alias("id"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        nxt = frontier.join(e, frontier["id"] == e["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = checkpointed(nxt.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, seeds: DataFrame, turns: int = 1000) -> DataFrame:
    """(id, depth): what edges (src, dst) reach from seeds (id), at its smallest depth; a fixpoint."""
    e = edges.select("src", "dst").distinct()
    seen = seeds.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, turns + 1):
        nxt = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(nxt.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def logistic_regression(rows: DataFrame, features: list[str], label: str, turns: int = 20, rate: float = 1.0) -> list[float]:
    """Weights (the last one constant) by gradient descent; each turn is one aggregate over all rows."""
    w = [0.0] * (len(features) + 1)
    for _ in range(turns):
        x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
        score = reduce(lambda a, b: a + b, [F.lit(v) * c for v, c in zip(w, x, strict=True)])
        error = 1 / (1 + F.exp(-score)) - F.col(label)
        row = rows.agg(*[F.avg(error * c) for c in x]).first()
        w = [v - rate * (g or 0.0) for v, g in zip(w, row, strict=True)]
    return w
