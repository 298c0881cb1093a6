"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document is a vector of statistics of its whole text. Standardised and mapped by random Fourier features they approximate a Gaussian
kernel. Each partition sums its part of the normal equations; the sums of all partitions are added by Spark, and the driver solves a
system of `FEATURES` unknowns. Scores are calibrated by isotonic regression (pool adjacent violators) on counts
in `BINS` bins of the raw score.

Labels come only from training rows. These have two folds: each fold's rows are scored for calibration by the ridge fit of
the other, and the final fit uses both, so no row calibrates the fit that has learned from it.

Scale: texts are read once; a written table of statistics feeds all passes. Shuffled are partition sums, whose size does not depend
on rows, and labels against ids.

Edge cases: statistics are of whole texts, however long; equal statistics have equal scores; null and empty texts have the statistics of an empty text and are scored; a null doc_id has no label; rows that repeat an id
count each; of several labels of an id the largest counts; without labels of both values the score is the share of label 1, or 0.5 without
any; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textstats

FEATURES = 256
BINS = 2000
GROUPS = 64
RIDGE = 1e-3
SEED = 17
SPAN = 4.0  # standardised statistics are cut at this many deviations

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
KINDS = {
    "upper": UPPER,
    "digit": np.array([48 <= b < 58 for b in range(256)]),
    "blank": np.array([chr(b) in textstats.BLANKS for b in range(256)]),
    "symbol": np.array([chr(b) in "#*$%&<>" for b in range(256)]),
    "pipe": np.array([b == 124 for b in range(256)]),
    "shout": np.array([b == 33 for b in range(256)]),
    "stop": np.array([chr(b) in ".,;:?" for b in range(256)]),
    "wide": np.array([b >= 0x80 for b in range(256)]),
}
KIND_MATRIX = np.stack([x.astype(float) for x in KINDS.values()])
N_STATS = len(KINDS) + 13


def statistics(text: str) -> list[float]:
    """`N_STATS` numbers of a text."""
    data = text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / size
    words = data.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split("\n")
    again = sum(textstats.repeated_lines(lines))
    hashes = textstats.word_hashes(words)
    return [
        *(KIND_MATRIX @ counts / size),
        np.log1p(len(words)), np.log1p(len(lines)), -float((p * np.log(p)).sum()) if len(p) else 0.0,
        float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        len(set(words)) / n, again / len(lines), textstats.repeated_words(hashes) / n, len(np.unique(textstats.windows(hashes, 2))) / n,
        np.log1p(len(data) / len(lines)),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[float(v) for v in statistics(x or "")] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


class Fourier:
    """Standardisation and random Fourier features of a Gaussian kernel; the last feature is constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turns = rng.normal(0, 1 / np.sqrt(2.0 * len(mean)), (len(mean), features))
        self.starts = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -SPAN, SPAN)
        z = np.sqrt(2 / self.turns.shape[1]) * np.cos(x @ self.turns + self.starts)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _sums(fourier: Fourier):
    """Per partition and fold the rows of the normal equations' matrix, the last one being of the targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(fold).tolist():
                z = np.hstack([fourier(x[fold == k]), y[fold == k, None]])
                total[k] = total.get(k, 0) + z.T @ z
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["fold", "i", "row"])

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    rows = np.array(group.column("row").to_pylist())
    return pa.table({"fold": [key[0].as_py()], "i": [key[1].as_py()], "row": [rows.sum(0).tolist()]}, schema=pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))]))


def solved(m: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from summed products of features and, last, the target; the constant is not penalised."""
    d = len(m) - 1
    penalty = np.full(d, ridge * max(1.0, m[d - 1, d - 1]))
    penalty[-1] = 1e-9
    return np.linalg.solve(m[:d, :d] + np.diag(penalty), m[:d, d])


def isotonic(n: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Nondecreasing fit to hits / n, weighted by n: adjacent violators are pooled. Bins without rows are left out by the caller."""
    blocks: list[list[float]] = []
    for weight, hit in zip(n.tolist(), hits.tolist(), strict=True):
        blocks.append([weight, hit, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            weight, hit, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + weight, blocks[-1][1] + hit, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), h / w) for w, h, k in blocks]) if blocks else np.zeros(0)


def _raw(fourier: Fourier, weights: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, y, fold = fourier(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.zeros(len(y))
            for k, w in weights.items():
                raw[fold == k] = z[fold == k] @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), pa.array(y)], ["bin", "y"])

    return run


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, at: np.ndarray, value: np.ndarray):
        self.fourier, self.weights, self.at, self.value = fourier, weights, at, value

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), float(self.value[0]))
        return np.clip(np.interp(self.fourier(stats) @ self.weights, self.at, self.value), 0, 1)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.written(common.mapped(docs, _stats, "doc_id long, stats array<double>"), "quality-stats")


def fitted(stats: DataFrame, labels: DataFrame, fold: str = "crc32(cast(cast(doc_id as string) as binary)) % 3", learn: tuple[int, int] = (0, 2)) -> Model:
    """Fit on rows whose fold is one of `learn`; `labels` has doc_id and y (0 or 1)."""
    labels = labels.where("doc_id is not null and y is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("double").alias("y"))
    labels = labels.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", F.expr(fold).cast("int")).where(F.col("fold").isin(*learn))
    rows = common.written(stats.join(labels, "doc_id").select("stats", "y", "fold"), "quality-rows")
    moments = [f(F.get("stats", F.lit(i))) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    head = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0)), *moments).first()
    if not head[0] or head[1] in (0, head[0]):
        return Model(None, None, np.zeros(1), np.array([head[1] / head[0] if head[0] else 0.5]))
    fourier = Fourier(np.array(head[2::2]), np.array(head[3::2]))
    sums = common.mapped(rows, _sums(fourier), "fold int, i int, row array<double>")
    # Added up in two levels, so that no group grows with the partitions
    some = sums.groupBy("fold", "i", F.spark_partition_id() % GROUPS).applyInArrow(_added, "fold int, i int, row array<double>")
    parts = some.groupBy("fold", "i").applyInArrow(_added, "fold int, i int, row array<double>").collect()
    size = FEATURES + 2
    sums = {k: np.zeros((size, size)) for k in learn}
    for r in parts:
        sums[r.fold][r.i] = r.row
    total = sum(sums.values())
    weights = solved(total)
    across = {k: solved(sums[other]) if sums[other].any() else weights for k, other in (learn, learn[::-1])}
    bins = common.mapped(rows, _raw(fourier, across), "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).orderBy("bin").toPandas()
    at = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    return Model(fourier, weights, at, isotonic(bins["n"].to_numpy(float), bins["hits"].to_numpy(float)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], ["doc_id", "score"])

    return run


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) per row of a statistics table."""
    return common.mapped(stats, _score(model), "doc_id long, score double")
