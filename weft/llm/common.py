"""Shared helpers of the training-data operators: scratch tables, bounded joins, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: A join side may be broadcast up to so many rows and so many bytes (as a plan estimates them); beyond that the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Batches that go to Python have so many bytes at most, unless the session says otherwise: rows have no bound of their own.
BATCH_BYTES = 8 << 20

scratch_path = scratch.path
_scopes: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the table read back.

    This cuts lineage: a lost executor costs the tasks it ran, never what was written. The table goes with `dropped` or `scope`, or when the program ends.
    """
    out = scratch.written(df, name)
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again."""
    for t in tables:
        scratch.deleted(t.sparkSession, t.weft_path)
        for made in _scopes:
            made[:] = [x for x in made if x is not t]


@contextmanager
def scope() -> Iterator[Callable[..., None]]:
    """Tables written inside are deleted at the end, but for those that the function given is called with: these pass to the scope around."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _scopes.remove(made)
        rest = [t for t in made if any(t is k for k in kept)]
        for t in made:
            if not any(t is k for k in rest):
                scratch.deleted(t.sparkSession, t.weft_path)
        if _scopes:
            _scopes[-1].extend(rest)


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`mapInArrow` with batches bounded in bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "1b") == "1b":  # not set
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(_releasing(function), schema)


def _releasing(function: Callable) -> Callable:
    """`function`; what a task of it no longer uses goes back to the system at its end, as workers outlive tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        released()

    return run


def released() -> None:
    """Give memory that is free inside this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_memories: dict[str, Callable[[], None]] = {}


def remembering(owner: str, forget: Callable[[], None]) -> None:
    """To be called where a task of `owner` begins: what other owners remember in this worker goes, so caches don't add up over a pipeline's stages.

    Caches may be parts of cycles, which only the collector frees.
    """
    others = [x for x in _memories if x != owner]
    for other in others:
        _memories.pop(other)()
    if others:
        gc.collect()
        released()
    _memories[owner] = forget


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows and few enough bytes, else with one for a shuffle, so that no guess of its size broadcasts it.

    `df` should be a written table, as its rows are counted first; its bytes are those of rows of the schema's default widths.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    width = df._jdf.queryExecution().analyzed().schema().defaultSize()
    return F.broadcast(df) if df.limit(rows + 1).count() <= min(rows, BROADCAST_BYTES // max(1, width)) else df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
