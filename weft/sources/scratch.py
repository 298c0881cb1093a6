"""Tables that live as long as the session, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; on a local master without one (tests) a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, at: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_end(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:
        deleted(spark, at)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read back; it is deleted when the program ends, if the session still runs then.

    This cuts lineage: a lost executor costs the tasks it ran, never what was written.
    """
    spark = df.sparkSession
    at, schema = path(spark, name), df.schema
    atexit.register(_at_end, spark, at)
    df.write.parquet(at)
    out = spark.read.schema(schema).parquet(at)
    out.weft_path = at
    return out
