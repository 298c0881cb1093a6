"""Near-duplicate detection: MinHash bands, odd sketches, confirmation on whole shingle sets.

1. A pass over the texts gives every document its set's size and digest, `BANDS` x `ROWS` MinHash samples as band hashes, and an
   odd sketch: a bitmap of the samples' parities. Documents with equal sets are one node from here on.
2. Nodes that share a band hash are candidates. The samples of two sets differ in a share of 1 - similarity, and the XOR of
   their sketches has a population count that grows with that number; pairs with too high a count are dropped. The limit
   is `DEVIATIONS` standard deviations below the similarity asked for. A second odd sketch folds the whole sets: the
   population count of its XOR is never more than the sets' difference, so it drops no pair that is similar enough.
3. What is left is confirmed on the sets of the whole texts: they are made once per node that has a candidate, and intersected by the engine, row by row.

No bucket is expanded into all its pairs. First, each member meets two pivots of its bucket: the member that shares most places
in buckets, which is the middle of its copies if there is one, and one at random. Confirmed links give components. Only in buckets that still have several components, members
outside the largest one meet those of other components, and the condition of the join holds both sketches, so what comes out of it is about as
much as there are links. Every pair that shares a bucket is therefore joined by a path of links, or has been tested: no link is lost.

Sets are of runs of `shingle` words: `SHINGLE` for op7, five for the pipeline's stage. With 45 bands of 5 rows, two sets of similarity 0.8 share no band with probability 2e-8.

Tables on the way have at most a file for `DOCS_A_FILE` documents, or two for each core, however many partitions a shuffle has; the tables whose joins may split a
crowded bucket keep a file per task.

Edge cases: very long texts give larger sets, of which a row has one, and nothing is cut; a null text counts as empty; an empty set links to nothing. A null doc_id is ignored when the smallest id is chosen, and is a component's
id only where all ids are null. Rows that repeat an id belong to one component if their sets do; of equal smallest ids one row is
kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components, textstats

BANDS, ROWS = 45, 5
PERCENT = 80
SHINGLE = 2
SKETCH_WORDS = 8  # of 64 bits
SAMPLES = BANDS * ROWS
SET_WORDS = 32  # of 64 bits, for the sketch of whole sets
DEVIATIONS = 5.0
IDS_SENT = 1_000_000  # 8 MB
DOCS_A_FILE = 10_000

_rng = np.random.default_rng(11)
_MUL = (_rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND = (_rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PLACE = (_rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ONE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `size` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = textstats.word_hashes(words)
    if len(hashes) < size:
        return textstats.windows(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(textstats.windows(hashes, size))


def minhashes(found: np.ndarray) -> np.ndarray:
    """`SAMPLES` minima of permuted 32-bit hashes."""
    xs = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(xs), 1024):
        v = xs[None, lo : lo + 1024] * _MUL
        v += _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(1), out)
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band; the band's number goes into it."""
    mixed = (samples.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * _BAND
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _ONE
    return (mixed.sum(1, dtype=np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) * _ONE)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of the samples' places in a bitmap."""
    places = ((samples.astype(np.uint64) + np.uint64(1)) * _PLACE) >> np.uint64(64 - 9)
    bits = np.bincount(places.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the places of all shingles; the XOR of two has at most as many ones as shingles that only one set has."""
    places = (found * _ONE) >> np.uint64(64 - 11)
    bits = np.bincount(places.astype(np.int64), minlength=64 * SET_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_limit(percent: int = PERCENT, deviations: float = DEVIATIONS) -> int:
    """Population count beyond which the XOR of two MinHash sketches rules the similarity out.

    With D differing samples 2D places are flipped at random in a bitmap of m bits: m / 2 (1 - exp(-4 D / m)) ones are expected; D is binomial, and the
    places' own variance is at most m / 4 (1 - exp(-8 D / m)).
    """
    share, m = 1 - percent / 100, 64 * SKETCH_WORDS
    differing = SAMPLES * share
    mean = m / 2 * (1 - np.exp(-4 * differing / m))
    sampling = SAMPLES * share * (1 - share) * (2 * np.exp(-4 * differing / m)) ** 2
    places = m / 4 * (1 - np.exp(-8 * differing / m))
    return int(np.ceil(mean + deviations * np.sqrt(sampling + places)))


def key_of(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("words", textstats.forget)
        uid, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys, sizes, bands, sketches, wholes = [], [], [], [], []
                for value in part.column(1):
                    found = shingles(value.as_py(), size)
                    key = key_of(found)
                    keys.append(key)
                    sizes.append(len(found))
                    if key is None or key in seen:
                        bands.append(None)
                        sketches.append(None)
                        wholes.append(None)
                    else:
                        seen.add(key)
                        samples = minhashes(found)
                        bands.append(band_hashes(samples))
                        sketches.append(odd_sketch(samples))
                        wholes.append(set_sketch(found))
                n = part.num_rows
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(range(uid, uid + n), pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(wholes, longs)],
                    ["doc_id", "uid", "key", "n_shingles", "bands", "sketch", "whole"],
                )
                uid += n

    return run


def _sets(wanted: np.ndarray | None, size: int):
    """Key and set of shingles, once per key and partition; of rows with a wanted id (or none) if the sorted ids are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("words", textstats.forget)
        seen: set[bytes] = set()
        for batch in batches:
            if wanted is not None:
                ids = batch.column(0)
                batch = batch.filter(pa.array(among(ids.fill_null(0).to_numpy(), wanted) | ids.is_null().to_numpy(zero_copy_only=False)))
            for lo in range(0, batch.num_rows, 256):
                keys, sets = [], []
                for value in batch.column(1)[lo : lo + 256]:
                    found = shingles(value.as_py(), size)
                    key = key_of(found)
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    return run


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _sketched(side: str) -> list[Column]:
    """The sketches' words as plain columns: conditions over them compile to straight code."""
    parts = [("s", "sketch", SKETCH_WORDS), ("w", "whole", SET_WORDS)]
    return [F.coalesce(F.get(array, F.lit(i)), F.lit(0)).alias(f"{side}_{x}{i}") for x, array, n in parts for i in range(n)]


def _xor(kind: str, words: int) -> Column:
    """Ones in the XOR of both sides' sketches."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"a_{kind}{i}").bitwiseXOR(F.col(f"b_{kind}{i}"))) for i in range(words)])


class _Search:
    """Tables of one run; see `near_dedup`."""

    def __init__(self, docs: DataFrame, percent: int, shingle: int):
        self.docs, self.percent, self.shingle = docs, percent, shingle
        self.limit = sketch_limit(percent)
        schema = "doc_id long, uid long, key binary, n_shingles long, bands array<long>, sketch array<long>, whole array<long>"
        self.signed = common.written(common.mapped(docs, _sign(shingle), schema), "near-signed")
        self.files = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-self.signed.count() // DOCS_A_FILE))
        first = self.signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands", True).alias("bands"), F.any_value("sketch", True).alias("sketch"), F.any_value("whole", True).alias("whole"))
        self.nodes = self.written(first.where("key is not null").withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """In few files: every new file costs a request to the shared folder, or, on a local disk without Hadoop's native library, two processes."""
        return common.written(df.coalesce(self.files), name)

    def members(self) -> DataFrame:
        """node and band (from 0) of each bucket with two nodes or more, with two pivots of the bucket."""
        rows = self.nodes.select("node", F.posexplode("bands").alias("band", "h"))
        sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = self.written(rows.join(sizes, "h"), "near-shared")
        ranked = shared.join(shared.groupBy("node").agg(F.sum("size").alias("places")), "node")
        pivots = ranked.groupBy("h").agg(F.max(F.struct("places", "node"))["node"].alias("p1"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("p2"))
        return self.written(shared.drop("size").join(pivots, "h"), "near-members")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches do not rule out."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), *_sketched(x))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(self.close()).select("a", "b")

    def close(self) -> Column:
        """What sizes and sketches leave possible. Similar sets differ in at most (100 - p) / (100 + p) of their sizes' sum."""
        sizes = 100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n")
        difference = _xor("w", SET_WORDS) * (100 + self.percent) <= (F.col("a_n") + F.col("b_n")) * (100 - self.percent)
        return sizes & (_xor("s", SKETCH_WORDS) <= self.limit) & difference

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links among written pairs (a, b), by the whole sets: these are made once per node, and intersected where the pairs are joined."""
        used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
        used = self.written(self.nodes.select("node", "key", "doc_id").join(used, "node"), "near-used")
        # IDs of one document per node: sent to the executors while they are few, else joined by a shuffle.
        if used.limit(IDS_SENT + 1).count() <= IDS_SENT:
            source, ids = self.docs, np.sort(used.select("doc_id").where("doc_id is not null").toArrow().column(0).to_numpy())
        else:
            source, ids = self.docs.join(used.select("doc_id").distinct(), self.docs["doc_id"].eqNullSafe(used["doc_id"]), "left_semi"), None
        sets = common.mapped(source, _sets(ids, self.shingle), "key binary, set array<long>").join(used.select("key", "node"), "key")
        # A key may come from several partitions: equal keys have equal sets
        sets = self.written(sets.groupBy("node").agg(F.any_value("set").alias("set")), "near-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("b_set")), "b")
        shared, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
        out = common.written(both.where(100 * shared >= self.percent * (total - shared)).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
        common.dropped(sets, used)
        return out

    def rest(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of a bucket that are not yet in one component and that sizes and sketches do not rule out."""
        joined = members.select("h", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        joined = self.written(joined, "near-rooted")
        sizes = joined.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size"))
        mixed = sizes.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("size", "root"))["root"].alias("main")).where("roots > 1").select("h", "main")
        left = joined.join(mixed, "h")
        full = self.written(left.join(self.nodes.select("node", "n", "bands", "sketch", "whole"), "node"), "near-mixed")
        side = lambda x: [F.col("node").alias(x), F.col("root").alias(f"{x}_root"), F.col("n").alias(f"{x}_n"), F.col("bands").alias(f"{x}_bands"), *_sketched(x)]
        a = full.where("root != main").select("h", "band", "main", *side("a"))
        b = full.select(F.col("h").alias("b_h"), *side("b"))
        # A pair of two members outside the main component is met twice, and any pair in each bucket that it shares: once is enough.
        once = (F.col("b_root") == F.col("main")) | (F.col("a") < F.col("b"))
        first = ~F.arrays_overlap(F.slice("a_bands", F.lit(1), F.col("band")), F.slice("b_bands", F.lit(1), F.col("band")))
        near = a.join(b, (F.col("h") == F.col("b_h")) & (F.col("a_root") != F.col("b_root")) & once & self.close() & first)
        return near.select("a", "b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. See the module for method and edge cases."""
    return _labelled(docs, id_col, text_col, percent, shingle).drop("uid", "key")


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int) -> DataFrame:
    """As `near_dedup`, with the row's uid (its partition's number and its place there) and the key of its set."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with common.scope() as keep:
        run = _Search(docs, percent, shingle)
        members = run.members()
        pivots = members.select(F.col("node").alias("a"), F.col("p1").alias("b")).unionAll(members.select("node", "p2")).where("a != b").distinct()
        tested = common.written(run.near(pivots), "near-pivots")
        links = run.confirmed(tested)
        roots = run.written(components.components(links, run.files), "near-roots")
        rest = run.rest(members, roots)
        done = tested.unionAll(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rest = common.written(rest.join(done, ["a", "b"], "left_anti"), "near-rest")
        if not rest.isEmpty():
            links = links.unionAll(run.confirmed(rest))
            roots = components.components(links, run.files)
        labels = run.nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("label"))
        rows = run.written(run.signed.select("doc_id", "uid", "n_shingles", "key").join(labels, "key", "left"), "near-labels")
        # The smallest id; a null id only where there is no other
        best = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"))
        best = run.written(best, "near-best")
        keep(rows, best)
    alone = F.col("label").isNull()
    return rows.join(common.bounded(best), "label", "left").select(
        "doc_id",
        "uid",
        "key",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (alone | (F.col("uid") == F.col("best.uid"))).alias("kept"),
    )


def _with_key(at: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(shingles(x.as_py(), size)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "_weft_key"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` of which one document of each component stays, with the columns of `docs`.

    Ids of which all rows are kept stay, ids of which none is go. Where rows that repeat an id are judged differently, their sets tell them apart, and of
    rows that repeat both one stays (all, if the set is empty).
    """
    with common.scope() as keep:
        found = _labelled(docs, id_col, text_col, percent, shingle)
        by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("n")).where("n < rows")
        by_id = common.written(by_id.select(F.col("doc_id").alias("_weft_id"), "n"), "near-gone")
        partly = by_id.where("n > 0").select("_weft_id")
        mixed = not partly.isEmpty()
        if mixed:
            sets = found.where("kept").join(partly, F.col("doc_id").eqNullSafe(F.col("_weft_id"))).select("_weft_id", F.col("key").alias("_weft_kept"))
            sets = common.written(sets.distinct(), "near-mixed-ids")
            keep(sets)
        keep(by_id)
    own = lambda left, right: left[id_col].cast("long").eqNullSafe(right["_weft_id"])
    gone = common.bounded(by_id.select("_weft_id"))
    out = docs.join(gone, own(docs, gone), "left_anti")
    if not mixed:
        return out
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = common.mapped(docs.join(partly, own(docs, partly), "left_semi"), _with_key(docs.columns.index(text_col), shingle), f"{fields}, _weft_key binary")
    again = marked.join(sets, own(marked, sets) & marked["_weft_key"].eqNullSafe(sets["_weft_kept"]), "left_semi")
    ones = again.where("_weft_key IS NOT NULL").dropDuplicates([id_col, "_weft_key"]).unionAll(again.where("_weft_key IS NULL"))
    return out.unionByName(ones.drop("_weft_key"))
