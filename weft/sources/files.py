"""Readers and sinks: delimited files of a social graph, graphs as Parquet, JDBC tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .schema import GraphSchema, Relation

# Formats of dates in delimited files.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def timestamp(column):
    """A timestamp from text in one of the formats, or from a number yyyyMMddHHmmssSSS."""
    text = column.cast("string")
    packed = F.try_to_timestamp(F.concat_ws(".", F.substring(text, 1, 14), F.substring(text, 15, 3)), F.lit("yyyyMMddHHmmss.SSS"))
    return F.when(text.rlike(r"^\d{17}$"), packed).otherwise(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]))


def packed_date(column):
    """The number yyyyMMddHHmmssSSS of a timestamp."""
    return F.date_format(column, "yyyyMMddHHmmssSSS").cast("long")


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = "|", header: bool = True) -> DataFrame:
    """A delimited file; without a schema all columns are text. A header may repeat a name: columns are then placed by position with a suffix."""
    reader = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def sniffed_delimiter(spark: SparkSession, path: str) -> str:
    """The likeliest delimiter of a file, by its first line."""
    line = spark.read.text(path).limit(1).collect()
    return max("|,\t;", key=lambda c: line[0][0].count(c)) if line else ","


def read_folder(spark: SparkSession, root: str, views: bool = False) -> dict[str, DataFrame]:
    """Every delimited file (`.csv`, or a folder of parts) right below `root` as a table by its name, with a header, its likeliest delimiter and inferred types; with `views` as
    temporary views too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    out = {}
    for status in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
        name, at = status.getPath().getName(), status.getPath().toString()
        if name.startswith(("_", ".")) or not (status.isDirectory() or name.endswith(".csv")):
            continue
        table = name.removesuffix(".csv")
        out[table] = spark.read.option("sep", sniffed_delimiter(spark, at)).option("header", True).option("inferSchema", True).csv(at)
        if views:
            out[table].createOrReplaceTempView(table)
    return out


def read_social_graph(spark: SparkSession, root: str, catalog: dict) -> PropertyGraph:
    """A graph from delimited files.

    `catalog` has `nodes` (label -> csv, delimiter, id_column, properties) and `edges` (name -> csv, delimiter, source_label, target_label, source_column,
    target_column, properties). Ids stay as they are: vertices are told apart by label and id. Date columns become timestamps; lists (`STRING[]`) stay text.
    """
    vertices, edges = {}, {}
    dates = {"creationDate", "birthday", "joinDate"}
    typed = lambda c: timestamp(F.col(f"`{c}`")).alias(c) if c in dates else F.col(f"`{c}`").alias(c)
    for label, n in catalog["nodes"].items():
        df = read_delimited(spark, f"{root}/{n['csv']}", delimiter=n.get("delimiter", "|"))
        key = n.get("id_column", "id")
        vertices[label] = df.select(F.col(f"`{key}`").cast("long").alias("id"), *[typed(c) for c in n.get("properties", []) if c != key and c in df.columns])
    for name, e in catalog["edges"].items():
        df = read_delimited(spark, f"{root}/{e['csv']}", delimiter=e.get("delimiter", "|"))
        # By position where both id columns have one name
        cols = [f"_{i}" if df.columns.count(c) > 1 or c not in (e.get("source_column"), e.get("target_column"), *e.get("properties", [])) else c for i, c in enumerate(df.columns)]
        df = df.toDF(*[f"c{i}" if c.startswith("_") else c for i, c in enumerate(cols)])
        src = e.get("source_column") if e.get("source_column") in df.columns else df.columns[0]
        dst = e.get("target_column") if e.get("target_column") in df.columns else df.columns[1]
        props = [typed(c) for c in e.get("properties", []) if c in df.columns and c not in (src, dst)]
        edges[Relation(e["source_label"], e.get("label", name), e["target_label"])] = df.select(F.col(f"`{src}`").cast("long").alias("src"), F.col(f"`{dst}`").cast("long").alias("dst"), *props)
    return PropertyGraph(vertices, edges)


def write_graph(graph: PropertyGraph, root: str) -> None:
    """Each label and relation as Parquet, and the schema as JSON."""
    for label, df in graph.vertex_tables.items():
        df.write.mode("overwrite").parquet(f"{root}/vertices/{label}")
    for r, df in graph.edge_tables.items():
        df.write.mode("overwrite").parquet(f"{root}/edges/{r.src}-{r.name}-{r.dst}")
    spark = next(iter(graph.vertex_tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(graph.schema.to_json()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/schema")


def read_graph(spark: SparkSession, root: str) -> PropertyGraph:
    """A graph that `write_graph` wrote: a read-only snapshot."""
    schema = GraphSchema.from_json(json.loads(spark.read.text(f"{root}/schema").first()[0]))
    vertices = {label: spark.read.parquet(f"{root}/vertices/{label}") for label in schema.labels}
    edges = {r: spark.read.parquet(f"{root}/edges/{r.src}-{r.name}-{r.dst}") for r in schema.relations}
    return PropertyGraph(vertices, edges, schema)


def sink_graph(query, vertices: list[str], edges: list[str], root: str) -> PropertyGraph:
    """A new graph of a query's vertex and edge tags, each vertex and edge once, written as Parquet and read back."""
    old = query.graph
    labels: dict[str, list[DataFrame]] = {}
    for tag in vertices:
        for label in query.tags[tag][1]:
            ids = query.df.where(F.col(f"{tag}__label") == label).select(F.col(f"{tag}__id").alias("id"))
            labels.setdefault(label, []).append(ids)
    tables = {}
    for label, parts in labels.items():
        ids = parts[0]
        for p in parts[1:]:
            ids = ids.unionAll(p)
        tables[label] = old.vertex_tables[label].join(ids.distinct(), "id", "left_semi")
    relations = {}
    for tag in edges:
        for r in dict.fromkeys(query.tags[tag][1]):
            own = [c for c in old.edge_tables[r].columns]
            rows = query.df.where((F.col(f"{tag}__label") == r.name) & (F.col(f"{tag}__src_label") == r.src) & (F.col(f"{tag}__dst_label") == r.dst))
            rows = rows.select(*[F.col(f"{tag}__{c}").alias(c) for c in own]).distinct()
            relations[r] = relations[r].unionByName(rows).distinct() if r in relations else rows
    write_graph(PropertyGraph(tables, relations), root)
    return read_graph(query.df.sparkSession, root)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of any database with a driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
