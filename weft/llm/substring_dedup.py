"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's UTF-8 bytes; where its low 16 bits fall below a threshold a chunk ends (at a character's end, `MIN_CHUNK` bytes
or more after the last end, `MAX_CHUNK` at most). Ends depend on the last 16 bytes alone, so an insertion shifts nothing beyond
the next ends. Neighbouring chunks that together have `SPAN` bytes or more form a variable span, which is identified by the digest of its bytes;
a span whose digest was seen before repeats an earlier one. Overlapping repeated spans of a document are joined; what has `LEAST`
bytes or more is a repeated passage, of which the first copy (by id, then row, then place) stays.

A passage loses on average 32 bytes at its start and 16 at its end before chunks agree, and what is left is held against `LEAST`. So not every
passage of over 50 words is found: by length, of 1,000 random ones each, 0.1 % at 112 bytes, 33 % at 150, 80.4 % at 180, 93 % at 200, 98.7 % at
228, 99.6 % at 257, and all at 291 and more. The ends of a passage stay in the text.

Scale: the first pass counts digests, summed per partition before the shuffle, so common passages cost a row a partition. A bitmap of
repeated digests of a fixed size then lets the second pass drop most unique spans where they are made; exact digests of 128 bits decide. It has 16 MB, and holds
some hundred million repeated digests; beyond that ever more unique spans are written and shuffled, which costs time and changes nothing else. A
passage that fills a third of all rows is summed map-side; its first copy is a row of a written table, so the join back to the copies is of two plain
shuffles, and adaptive execution splits the copies and repeats that row.

Edge cases: very long texts are chunked whole; of equal ids the earlier row of the earlier partition comes first; a null text counts as empty and has no spans; a null doc_id comes first in the order of ids; rows that repeat are copies of
each other; repeats within one document count too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_CHUNK, MAX_CHUNK = 8, 256
RATE = 16  # bytes from one possible end to the next, on average
SPAN = 64
LEAST = 112
MAP_BITS = 27
MAP_BLOCKS = 10

GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
CONTINUES = np.array([(b & 0xC0) == 0x80 for b in range(256)])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: every byte's number enters at the right and moves left by a bit a byte. Of 32 bits the low 16 are used, so 16 bytes matter."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # from runs of `step` bytes to runs of twice as many
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; the last one is its length."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    if n <= MIN_CHUNK:
        return [n] if n else []
    low = gear_hashes(raw) & np.uint32(0xFFFF)
    good = low < np.uint32(65536 // RATE)
    starts = ~CONTINUES[raw]
    good[:-1] &= starts[1:]  # the next byte begins a character
    out, last = [], 0
    for end in (np.flatnonzero(good) + 1).tolist():
        while end - last > MAX_CHUNK:
            cut = last + MAX_CHUNK
            while not starts[cut]:
                cut -= 1
            out.append(cut)
            last = cut
        if end - last >= MIN_CHUNK:
            out.append(end)
            last = end
    while n - last > MAX_CHUNK:
        cut = last + MAX_CHUNK
        while not starts[cut]:
            cut -= 1
        out.append(cut)
        last = cut
    if last < n:
        out.append(n)
    return out


def spans(data: bytes) -> list[tuple[int, int]]:
    """For each chunk the shortest run of chunks from it that has `SPAN` bytes or more."""
    ends = chunk_ends(data)
    starts, out, k = [0, *ends[:-1]], [], 0
    for start in starts:
        while k < len(ends) and ends[k] - start < SPAN:
            k += 1
        if k == len(ends):
            break
        out.append((start, ends[k]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests (64 bits) of a partition's spans with how often each occurs, held for at most a few million at a time."""
    parts: list[int] = []

    def summed() -> pa.RecordBatch:
        values, counts = np.unique(np.array(parts, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["d", "n"])

    for batch in batches:
        for value in batch.column(0):
            data = (value.as_py() or "").encode("utf-8", "surrogatepass")
            parts += [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans(data)]
            if len(parts) > 2_000_000:
                yield summed()
                parts = []
    if parts:
        yield summed()


def _bitmap(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << (MAP_BITS - MAP_BLOCKS), np.uint8)
    bits[group.column("bit").to_numpy()] = 1
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _rows(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        shift = np.uint64(64 - MAP_BITS)
        for batch in batches:
            docs, uids, his, los, starts, ends = [], [], [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                found = spans(data)
                if found:
                    at = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in found], np.uint64) >> shift
                    hit = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
                    for k in np.flatnonzero(hit).tolist():
                        a, b = found[k]
                        digest = xxhash.xxh3_128_intdigest(data[a:b])
                        docs.append(doc)
                        uids.append(uid)
                        his.append((digest >> 64) - (1 << 63))
                        los.append((digest & ((1 << 64) - 1)) - (1 << 63))
                        starts.append(a)
                        ends.append(b)
                uid += 1
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, uids, his, los, starts, ends)], ["doc_id", "uid", "hi", "lo", "start", "end"])

    return run


def repeated_bitmap(docs: DataFrame) -> np.ndarray:
    """Bitmap, of a fixed size, of the leading bits of digests that occur twice or more."""
    counted = common.mapped(docs.select("text"), _count, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 1")
    low = MAP_BITS - MAP_BLOCKS
    lead = F.shiftrightunsigned("d", 64 - MAP_BITS)
    places = counted.select(F.shiftrightunsigned(lead, low).cast("int").alias("block"), lead.bitwiseAND((1 << low) - 1).cast("int").alias("bit")).distinct()
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = 1 << (low - 3)
    for r in places.groupBy("block").applyInArrow(_bitmap, "block int, bits binary").collect():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans whose digest may be repeated, and the first span of every digest that is."""
    held = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(docs))
    rows = common.written(common.mapped(docs, lambda batches: _rows(held.value)(batches), "doc_id long, uid long, hi long, lo long, start long, end long"), "substring-rows")
    first = rows.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "uid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows, common.written(first.drop("n"), "substring-first")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that repeats an earlier one: doc_id, uid (of the row), start, end (UTF-8 bytes), first_doc_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scope() as keep:
        rows, first = _repeated(docs)
        keep(rows, first)
    later = rows.join(first.hint("merge"), ["hi", "lo"]).where((F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start")))
    own = Window.partitionBy("uid").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.select("doc_id", "uid", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.coalesce((F.col("start") > before).cast("int"), F.lit(1)).alias("new"))
    joined = marked.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("uid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    return out.where(F.col("end") - F.col("start") >= LEAST).select("doc_id", "uid", "start", "end", "first_doc_id")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text less the passages, given in bytes of UTF-8."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in sorted(cuts):
        out.append(data[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
