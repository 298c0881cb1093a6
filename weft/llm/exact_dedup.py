"""Exact dedup with counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints of its normalised texts.
The filters are cut into blocks by the leading fingerprint bits; blocks with the same bits are merged by their
sorted remainders, adding counts, which loses nothing. Fingerprints counted more than once route their documents to
byte verification, which groups by the whole normalised text. A fingerprint shared by different texts
thus costs a comparison and never a document.

Scale: only fingerprints, digests and ids are shuffled for unique texts. Texts are shuffled only for routed
documents, and after a map-side grouping, so a text that fills a third of all rows crosses the network once a partition.

Edge cases: very long texts are read, hashed and compared whole; a null text counts as empty; all empty texts are equal. A null doc_id is the smallest id. Rows that repeat
both id and text are copies like any others: one of them is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BITS = 12
QUOTIENT_BITS = 8
REMAINDER_BITS = 64 - BLOCK_BITS - QUOTIENT_BITS
#: A list of routed fingerprints is sent to the executors up to so many; beyond that the routing is a shuffled semi-join.
ROUTED_ROWS = 1_000_000  # 8 MB

MARKS = "doc_id long, uid long, fp long, text_sha256 string"


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprint(data: bytes) -> int:
    """Signed 64-bit fingerprint."""
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


class QuotientFilter:
    """Counting quotient filter of one block, in its compact form.

    `runs[q]` is the length of the run of quotient q; `remainders` holds the runs one after the other, each sorted;
    `counts` is how often each fingerprint was added.
    """

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def of_sorted(cls, keys: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct sorted keys of quotient and remainder bits."""
        runs = np.bincount((keys >> np.uint64(REMAINDER_BITS)).astype(np.int64), minlength=1 << QUOTIENT_BITS)
        return cls(runs.astype("<u4"), keys & np.uint64((1 << REMAINDER_BITS) - 1), counts)

    def keys(self) -> np.ndarray:
        quotients = np.repeat(np.arange(1 << QUOTIENT_BITS, dtype=np.uint64), self.runs)
        return (quotients << np.uint64(REMAINDER_BITS)) | self.remainders

    def dump(self) -> bytes:
        return self.runs.astype("<u4").tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        head = 4 << QUOTIENT_BITS
        n = (len(data) - head) // 12
        return cls(np.frombuffer(data, "<u4", 1 << QUOTIENT_BITS), np.frombuffer(data, "<u8", n, head), np.frombuffer(data, "<u4", n, head + 8 * n))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Lossless merge: keys in order, the counts of equal keys added (held at the largest number that fits)."""
        keys = np.concatenate([f.keys() for f in filters])
        order = np.argsort(keys, kind="stable")  # a merge of sorted runs
        keys, counts = keys[order], np.concatenate([f.counts for f in filters])[order].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return cls.of_sorted(keys[first], np.minimum(np.add.reduceat(counts, first), 0xFFFFFFFF))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        fps, digests = [], []
        for value in batch.column(1):
            data = normalised(value.as_py())
            fps.append(fingerprint(data))
            digests.append(hashlib.sha256(data).hexdigest())
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(range(uid, uid + n), pa.int64()), pa.array(fps, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "uid", "fp", "text_sha256"])
        uid += n


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [batch.column(0).to_numpy().view(np.uint64) for batch in batches]
    if not parts or not sum(map(len, parts)):
        return
    fps, counts = np.unique(np.concatenate(parts), return_counts=True)
    blocks = (fps >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    mask = np.uint64((1 << (64 - BLOCK_BITS)) - 1)
    at = [*starts.tolist(), len(fps)]
    for lo in range(0, len(starts), 256):
        spans = [(a, b) for a, b in zip(at[lo : lo + 256], at[lo + 1 : lo + 257], strict=False)]
        dumps = [QuotientFilter.of_sorted(fps[a:b] & mask, counts[a:b]).dump() for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a]) for a, _ in spans], pa.int32()), pa.array(dumps, pa.binary())], ["block", "filter"])


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    merged = QuotientFilter.merged([QuotientFilter.load(x.as_py()) for x in group.column("filter")])
    often = merged.counts > 1
    fps = merged.keys()[often] | (np.uint64(key[0].as_py()) << np.uint64(64 - BLOCK_BITS))
    return pa.table({"fp": pa.array(fps.view(np.int64), pa.int64()), "n": pa.array(merged.counts[often].astype(np.int64), pa.int64())})


def repeated_fingerprints(marks: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once in column fp, with their counts: the merged filters' entries above one."""
    filters = marks.select("fp").mapInArrow(_build, "block int, filter binary")
    return filters.groupBy("block").applyInArrow(_merge, "fp long, n long")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _routed(fps: np.ndarray | None):
    """Normalised texts with their digests; only those with a listed fingerprint if there is a sorted list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                texts = [normalised(x.as_py()) for x in batch.column(0)[lo : lo + 512]]
                fp = np.array([fingerprint(x) for x in texts], np.int64)
                at = range(len(texts)) if fps is None else np.flatnonzero(_among(fp, fps)).tolist()
                fp, data = fp[list(at)], [texts[k] for k in at]
                digest = [hashlib.sha256(x).hexdigest() for x in data]
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(data, pa.binary()), pa.array(digest, pa.string())], ["fp", "data", "text_sha256"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. See the module for edge cases."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scope() as keep:
        marks = common.written(common.mapped(docs, _mark, MARKS), "dedup-marks")
        repeated = common.written(repeated_fingerprints(marks), "dedup-repeated")
        listed = repeated.limit(ROUTED_ROWS + 1).count() <= ROUTED_ROWS
        fps = np.sort(repeated.select("fp").toArrow().column(0).to_numpy()) if listed else None
        routed = common.mapped(docs.select("text"), _routed(fps), "fp long, data binary, text_sha256 string")
        if not listed:
            routed = routed.join(repeated.select("fp"), "fp", "left_semi")
        # Byte verification: the grouping key is the whole normalised text.
        verified = routed.groupBy("data").agg(F.count(F.lit(1)).alias("rows"), F.first("text_sha256").alias("text_sha256")).where("rows > 1").select("text_sha256", "rows")
        best = marks.join(common.bounded(repeated.select("fp")), "fp", "left_semi").groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("best"))
        classes = common.written(verified.join(best, "text_sha256").select("text_sha256", F.col("rows").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid")), "dedup-classes")
        keep(marks, classes)
    both = marks.drop("fp").join(common.bounded(classes), "text_sha256", "left")
    single = F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def _with_digest(at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(normalised(x.as_py())).hexdigest() for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "_weft_sha"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact dedup keeps, with the columns of `docs`.

    The dropped ids are removed by an anti-join on id and digest. Rows that repeat id and text are reduced to one.
    """
    found = exact_dedup(docs, id_col, text_col)
    rows = common.written(found.where("group_size > 1").select(F.col("doc_id").alias("_weft_id"), F.col("text_sha256").alias("_weft_sha"), "kept"), "dedup-rows")
    drop = rows.groupBy("_weft_id", "_weft_sha").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("rows"))
    drop = common.written(drop.where("not any or rows > 1"), "dedup-drop")
    schema = docs.schema.simpleString()[7:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = common.mapped(docs, _with_digest(docs.columns.index(text_col), None), f"{fields}, _weft_sha string") if schema else docs
    on = lambda left, right: left["_weft_sha"].eqNullSafe(right["_weft_sha"]) & left[id_col].cast("long").eqNullSafe(right["_weft_id"])
    gone = common.bounded(drop)
    out = marked.join(gone, on(marked, gone), "left_anti").drop("_weft_sha")
    twice = drop.where("any and rows > 1")
    if not common.is_empty(twice):
        again = marked.join(twice, on(marked, twice), "left_semi").dropDuplicates([id_col, "_weft_sha"]).drop("_weft_sha")
        out = out.unionByName(again)
    return out
