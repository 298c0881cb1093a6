"""Corpus pipeline: stages over documents, each of which gets what its predecessor kept.

Edge cases, for all stages: very long texts are read whole; an empty table passes through as one; extra columns stay, whatever their names, until packing, which returns its own.
What null, tied and repeated rows become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common, exact_dedup, line_rules, near_dedup, packing, secrets
from weft.llm.queries import tokenizer_file

NEAR_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the labelled lines reject go. Null and empty texts fail the base rules; repeated rows are judged alike; a null id is no matter."""
    field = line_rules.learned(docs, common.table(spark, sf_dir, "labels"))
    return line_rules.kept_rows(docs, field)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; a null id is the smallest, and of rows that repeat id and text one stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, by runs of five words, the document with the smallest id stays; one with a null id only where all ids are null. Texts without words stay."""
    return near_dedup.keep_one(docs, shingle=NEAR_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become marks, and n_chars follows. A null text stays null, and its n_chars as it is."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in out.columns else out


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences. A null or empty text is its end id alone; a null id stays null."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("secret scans", secret_scans),
    ("packing", packed_sequences),
]

#: SQL can't express the stages' methods; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # What a stage needed on the way goes as soon as its result is written
        with common.scope() as keep:
            docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
