"""Connected components over a table of links, by alternating large and small stars.

Every round joins nodes to the smallest node they know; links never leave the executors. Tables between rounds are written to the shared
folder. A hub's links are split by the join, as each side of it has one row a link or one row a node.

Edge cases: no links give no rows; loops and repeated links count once; links with a null end join nothing and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to the smallest node it knows."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, link to the smallest of them. Links go from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node and root (its component's smallest node) of every node that is not the smallest of its component.

    `links` has columns u and v (long); either order, repeats and loops may occur. Tables between rounds have at most so many files, if that is given.
    """
    write = lambda df: common.written(df if files is None else df.coalesce(files), "links")
    now = write(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        new = write(_small(_large(now)))  # the large stars' exchange is made once and read twice
        common.dropped(now)
        now, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
