"""Bounded streams of rows, as a thin layer over DataFrames.

Functions are Spark expressions (SQL text or columns). Where a user's Python function is wanted, `unary`, `binary`, `segment_apply` and `reduce_by_key` take batches as pandas
frames. Results that a dataflow leaves to chance (order of lists, rows of a limit) are as arbitrary here unless an order is given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import checkpointed

Expr = str | Column


def _col(x: Expr) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Stream:
    def __init__(self, df: DataFrame, keys: tuple[str, ...] = ()):
        self.df, self.keys = df, keys

    @classmethod
    def source(cls, spark: SparkSession, rows, schema: str) -> Stream:
        return cls(spark.createDataFrame(list(rows), schema))

    def _of(self, df: DataFrame) -> Stream:
        return Stream(df, tuple(k for k in self.keys if k in df.columns))

    # --- one row at a time

    def map(self, **columns: Expr) -> Stream:
        return self._of(self.df.select(*[_col(x).alias(n) for n, x in columns.items()]))

    def filter_map(self, **columns: Expr) -> Stream:
        """As map; rows whose values are all NULL go."""
        out = self.map(**columns)
        return out._of(out.df.dropna("all"))

    def flat_map(self, name: str, array: Expr) -> Stream:
        """A row per element of an array."""
        return self._of(self.df.select(F.explode(_col(array)).alias(name)))

    unfold = flat_map

    def filter(self, condition: Expr) -> Stream:
        return self._of(self.df.where(_col(condition)))

    def branch(self, condition: Expr) -> tuple[Stream, Stream]:
        """Rows for which the condition holds, and the others (also where it is NULL)."""
        holds = F.coalesce(_col(condition), F.lit(False))
        return self._of(self.df.where(holds)), self._of(self.df.where(~holds))

    switch = branch

    def copied(self) -> tuple[Stream, Stream]:
        """The rows twice; they are made once, and written."""
        once = self._of(checkpointed(self.df))
        return once, once

    def unary(self, function: Callable, schema: str) -> Stream:
        """A function from an iterator of pandas frames to one, per partition."""
        return self._of(self.df.mapInPandas(function, schema))

    def binary(self, other: Stream, key: str, function: Callable, schema: str) -> Stream:
        """A function of both sides' rows of a key as pandas frames; a key's rows must fit in memory."""
        return Stream(self.df.groupBy(key).cogroup(other.df.groupBy(key)).applyInPandas(function, schema))

    # --- all rows

    def merge(self, other: Stream) -> Stream:
        return self._of(self.df.unionByName(other.df, allowMissingColumns=True))

    def merge_tagged(self, other: Stream, tag: str = "side") -> Stream:
        """Both sides' rows with a column that tells the side, 0 or 1."""
        return self._of(self.df.withColumn(tag, F.lit(0)).unionByName(other.df.withColumn(tag, F.lit(1)), allowMissingColumns=True))

    def zip(self, other: Stream, order: tuple[str, ...], other_order: tuple[str, ...]) -> Stream:
        """Pairs of the k-th rows of both sides in their orders; the longer side's rest goes. Rows are numbered by sorted partitions."""
        a, b = _numbered(self.df, order), _numbered(other.df, other_order)
        return self._of(a.join(b, "_row").drop("_row"))

    def count(self) -> Stream:
        return Stream(self.df.agg(F.count(F.lit(1)).alias("count")))

    def fold(self, **aggs: Expr) -> Stream:
        """Aggregates over all rows, e.g. total="sum(x)"."""
        return Stream(self.df.agg(*[_col(x).alias(n) for n, x in aggs.items()]))

    def reduce(self, function: Callable) -> Stream:
        """One row from all, by an associative and commutative function of two rows as dicts. Partitions are reduced first, then groups of partial results, then these.

        Batches go through Python as Arrow; whatever `fold` can express runs without it. No rows give no row.
        """
        groups = max(1, int(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
        some = self.reduce_partition(function).df.repartition(groups).mapInPandas(_reducer(function, self.df.columns), self.df.schema)
        return self._of(some.repartition(1).mapInPandas(_reducer(function, self.df.columns), self.df.schema))

    def reduce_partition(self, function: Callable) -> Stream:
        """As reduce, a row per partition that has any."""
        return self._of(self.df.mapInPandas(_reducer(function, self.df.columns), self.df.schema))

    def fold_partition(self, **aggs: Expr) -> Stream:
        """Aggregates per partition."""
        rows = self.df.withColumn("_part", F.spark_partition_id())
        return Stream(rows.groupBy("_part").agg(*[_col(x).alias(n) for n, x in aggs.items()]).drop("_part"))

    def collect(self, column: str) -> Stream:
        """All values of a column as one sorted array: for results that fit in one row."""
        return Stream(self.df.agg(F.sort_array(F.collect_list(column)).alias(column)))

    def any(self) -> bool:
        return not self.df.isEmpty()

    def limit(self, n: int) -> Stream:
        return self._of(self.df.limit(n))

    def limit_partition(self, n: int) -> Stream:
        """At most n rows of each partition: those that the partition has first."""
        low = (1 << 33) - 1  # an increasing id has the row's number in its partition in the lower bits
        rows = self.df.withColumn("_row", F.monotonically_increasing_id())
        return self._of(rows.where(F.col("_row").bitwiseAND(low) < n).drop("_row"))

    def sort_by(self, *keys: Expr) -> Stream:
        return self._of(self.df.orderBy(*[_col(k) for k in keys] or self.df.columns))

    def sort_limit(self, n: int, *keys: Expr) -> Stream:
        return self._of(self.sort_by(*keys).df.limit(n))

    # --- keys

    def key_by(self, *columns: str) -> Stream:
        return Stream(self.df, columns)

    def partition_by_key(self) -> Stream:
        return self._of(self.df.repartition(*self.keys))

    def dedup(self) -> Stream:
        """One row per key (or per value, without keys)."""
        return self._of(self.df.dropDuplicates(list(self.keys) or None))

    def fold_by_key(self, **aggs: Expr) -> Stream:
        return self._of(self.df.groupBy(*self.keys).agg(*[_col(x).alias(n) for n, x in aggs.items()]))

    def reduce_by_key(self, function: Callable) -> Stream:
        """One row per key, by an associative and commutative function of two rows as dicts: partitions reduce their own rows of a key before the shuffle."""
        keys, names, schema = list(self.keys), self.df.columns, self.df.schema
        partial = self.df.mapInPandas(_reducer(function, names, keys), schema)
        return self._of(partial.groupBy(*keys).applyInPandas(lambda frame: next(_reducer(function, names)(iter([frame]))), schema))

    def accumulate_by_key(self, accumulator: type, column: str, schema: str) -> Stream:
        """A user's accumulator per key: a class with `add(value)`, `merge(other)` and `result()`. Each partition fills its own, which are pickled and merged.

        `schema` is the result's: the keys' columns, then one of the accumulator's result.
        """
        from pyspark import cloudpickle

        keys, state = list(self.keys), "_state binary"
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.select(*keys).schema)

        def fill(frames):
            held: dict = {}
            for frame in frames:
                for *key, value in frame[[*keys, column]].itertuples(index=False, name=None):
                    held.setdefault(tuple(key), accumulator()).add(value)
            yield _frame([(*key, cloudpickle.dumps(acc)) for key, acc in held.items()], [*keys, "_state"])

        def merged(key, frame):
            whole = accumulator()
            for raw in frame["_state"]:
                whole.merge(cloudpickle.loads(raw))
            return _frame([(*key, whole.result())], names)

        from pyspark.sql.types import _parse_datatype_string

        names = _parse_datatype_string(schema).names
        return self._of(self.df.select(*keys, column).mapInPandas(fill, f"{kept}, {state}").groupBy(*keys).applyInPandas(merged, schema))

    def segment_apply(self, function: Callable, schema: str) -> Stream:
        """A pandas function per key; a key's rows must fit in memory."""
        return self._of(self.df.groupBy(*self.keys).applyInPandas(function, schema))

    def join(self, other: Stream, kind: str = "inner") -> Stream:
        """On the keys of both: inner, left, right, full, left_semi, left_anti. The right side's keys take the left one's names."""
        right = reduce(lambda d, p: d.withColumnRenamed(*p), zip(other.keys, self.keys, strict=True), other.df)
        return self._of(self.df.join(right, list(self.keys), kind))

    def apply(self, task: Callable[[Stream], Stream], **agg: Expr) -> Stream:
        """Per key, an aggregate of what a subtask makes of the key's rows; keys for which it makes nothing have NULL."""
        done = task(self)
        rows = done.df.groupBy(*self.keys).agg(*[_col(x).alias(n) for n, x in agg.items()])
        return self._of(self.df.join(rows, list(self.keys), "left"))

    # --- exchange

    def repartition(self, n: int) -> Stream:
        return self._of(self.df.repartition(n))

    def aggregate(self) -> Stream:
        """All rows to one partition: for small results."""
        return self._of(self.df.coalesce(1))

    def broadcast(self, most_rows: int = 1_000_000) -> Stream:
        """With a broadcast hint for joins, if there are few enough rows; as it is otherwise."""
        return self._of(F.broadcast(self.df) if self.df.limit(most_rows + 1).count() <= most_rows else self.df)

    def sink_into(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


def _reducer(function: Callable, names: list[str], keys: list[str] | None = None):
    """Over an iterator of frames: one frame of the reduced row, or of one row per key."""

    def run(frames):
        held: dict = {}
        for frame in frames:
            for row in frame.to_dict("records"):
                key = tuple(row[k] for k in keys or ())
                held[key] = function(held[key], row) if key in held else row
        yield _frame([tuple(row[n] for n in names) for row in held.values()], names)

    return run


def _numbered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Row numbers from 0 in an order, without bringing all rows to one task: ranges are sorted, and each begins after the earlier ones' rows.

    The ranges are written once: rows and sizes must come from the same deal, which two branches of a plan do not promise.
    """
    from pyspark.sql import Window

    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumn("_own", F.row_number().over(own) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before.drop("_n"), "_part").withColumn("_row", F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
