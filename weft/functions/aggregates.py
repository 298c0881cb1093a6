"""Aggregates of group_by and apply. NULL is ignored by all; over no values MIN, MAX, SUM and AVG are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("count", "count_distinct", "sum", "min", "max", "avg", "to_list", "to_set")


def aggregate(name: str, *columns: Column) -> Column:
    """Without columns, `count` counts rows. Lists and sets are sorted, so that results do not depend on the order of rows."""
    if name == "count" and not columns:
        return F.count(F.lit(1))
    if name == "count_distinct":
        return F.count_distinct(*columns)
    if len(columns) != 1:
        raise ValueError(f"{name} takes one column")
    plain = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
    if name in plain:
        return plain[name](columns[0])
    if name in ("to_list", "to_set"):
        return F.sort_array((F.collect_list if name == "to_list" else F.collect_set)(columns[0]))
    raise ValueError(f"no aggregate {name}")
