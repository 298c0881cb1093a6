"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels the lines of a text as content or boilerplate; Viterbi decoding finds the
best labels, and a document is kept if at least `CONTENT_SHARE` of its words stand in content lines and it passes the base rules
(at least 20 words; at most 30 % of words in repeated 8-word windows).

Lines have no labels of their own, so the field is trained here with latent ones, from labelled documents: all lines of a document of quality 1 are content, and of
one of quality 0 at least one line is boilerplate, no matter which. The likelihood of such documents is that of all labellings that agree: of the labelling
without boilerplate, or of all the others. What sets the lines of bad documents apart so becomes boilerplate, and lines in them that look as those of good ones do
stay content. Both qualities weigh the same.

`TRAIN_DOCS` documents of each quality at most, those with the smallest hashes of their ids, are used, whole documents with all their lines; they go on, in that order,
up to `TRAIN_LINES` lines of each quality. What reaches the driver is bounded by these. A text of more than `CHAIN` lines is several chains in training. Decoding uses whole texts.

Scale: one pass over documents without a shuffle; the model is a few dozen numbers.

Edge cases: null and empty texts have no words and fail the base rules; a null doc_id stays null; repeated rows are judged each; very long
texts take time in proportion to their lines; of equally good labellings the one with content is taken; a row of labels for an id without a document
is ignored; without labels of both qualities no line is boilerplate; an empty table gives an
empty result; other columns are ignored by `judged` and kept by `kept_rows`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textstats

TRAIN_DOCS = 1500
TRAIN_LINES = 100_000
CHAIN = 256
STEPS = 100
CONTENT_SHARE = 0.5
MIN_WORDS = 20
REPEAT_PERCENT = 30

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


UPPER = bytes(range(ord("A"), ord("Z") + 1))
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")


def capitals(line: str) -> int:
    """Capital letters of the whole line, as str.isupper has them."""
    plain = line.encode("ascii", "ignore")
    n = len(plain) - len(plain.translate(None, UPPER))
    return n if len(plain) == len(line) else n + sum(map(str.isupper, BEYOND_ASCII.findall(line)))


def features(lines: list[str], again: list[bool]) -> np.ndarray:
    """A row of features, each from 0 to 1, per line."""
    rows = []
    for line, dup in zip(lines, again, strict=True):
        n = len(line)
        if not n:
            rows.append((1.0, 1.0, *[0.0] * 12))
            continue
        words = line.split()
        k = len(words)
        upper = capitals(line) / n
        pipes = line.count("|")
        signs = textstats.symbols(line) - pipes
        rows.append((
            1.0, 0.0, float(dup), float(k <= 3), float(3 < k <= 8),
            min(1.0, 5 * pipes / max(k, 1)), min(1.0, 2 * signs / max(k, 1)), min(1.0, 2 * line.count("!") / max(k, 1)),
            upper, sum(map(line.count, "0123456789")) / n, 1 - len(set(words)) / max(k, 1),
            min(1.0, n / max(k, 1) / 20), float(line[-1] in ".?!:;\"'"), float("://" in line or "@" in line),
        ))
    return np.array(rows, np.float64).reshape(len(lines), 14)


N_FEATURES = 14


@dataclass
class Field:
    """Weights for label 1 (boilerplate) against 0, and scores of transitions [from, to]."""

    weights: np.ndarray
    steps: np.ndarray

    def viterbi(self, rows: np.ndarray) -> list[int]:
        scores = (rows @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores):
            if k:
                to0, to1 = (b + s10 > a + s00), (b + s11 > a + s01)
                back.append((to0, to1))
                a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + s
            else:
                b = s
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1] if scores else []


class Chains:
    """Training texts as chains, the longest first: rows of features one after the other, where each chain begins, and its quality."""

    def __init__(self, docs: list[tuple[np.ndarray, int]]):
        cut = [(x[k : k + CHAIN], quality) for x, quality in docs for k in range(0, len(x), CHAIN)]
        cut.sort(key=lambda c: -len(c[0]))
        self.lengths = np.array([len(x) for x, _ in cut], np.int64)
        self.quality = np.array([q for _, q in cut], np.int64)
        self.rows = np.concatenate([x for x, _ in cut]) if cut else np.zeros((0, N_FEATURES))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        # How many chains have a line at each place
        self.alive = [int((self.lengths > k).sum()) for k in range(self.lengths.max(initial=0))]
        counts = np.bincount(self.quality, minlength=2).clip(1)
        self.weights = 0.5 / counts[self.quality]


def likelihood(w: np.ndarray, t: np.ndarray, chains: Chains) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of the documents' qualities, and its gradient by weights and transitions.

    With p the probability of the labelling without boilerplate, a chain of quality 1 counts log p and one of quality 0 log(1 - p).
    """
    own, starts = chains.rows @ w, chains.starts
    forth = np.zeros((len(own), 2))
    for k, n in enumerate(chains.alive):
        at = starts[:n] + k
        if k:
            forth[at] = np.logaddexp(forth[at - 1][:, :1] + t[0], forth[at - 1][:, 1:] + t[1])
        forth[at, 1] += own[at]
    ends = starts + chains.lengths - 1
    z = np.logaddexp(forth[ends, 0], forth[ends, 1])
    log_p = (chains.lengths - 1) * t[0, 0] - z
    p = np.exp(log_p)
    good = chains.quality == 1
    q = np.maximum(-np.expm1(log_p), 1e-300)
    value = float(chains.weights @ np.where(good, log_p, np.log(q)))
    scale = chains.weights * np.where(good, 1.0, -p / q)  # of the gradient of log p
    back, p1, pairs = np.zeros((len(starts), 2)), np.zeros(len(own)), np.zeros((len(starts), 2, 2))
    for k in range(len(chains.alive) - 1, -1, -1):
        n = chains.alive[k]
        at = starts[:n] + k
        p1[at] = np.exp(forth[at, 1] + back[:n, 1] - z[:n])
        if k:
            ahead = back[:n].copy()
            ahead[:, 1] += own[at]
            pairs[:n] += np.exp(forth[at - 1][:, :, None] + t + ahead[:, None, :] - z[:n, None, None])
            back[:n] = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
    grad_w = -(p1 * np.repeat(scale, chains.lengths)) @ chains.rows
    grad_t = -np.einsum("i,iab->ab", scale, pairs)
    grad_t[0, 0] += scale @ (chains.lengths - 1)
    return value, grad_w, grad_t


def trained(docs: list[tuple[np.ndarray, int]], steps: int = STEPS, ridge: float = 1e-4) -> Field:
    """Field of greatest likelihood: each document has its lines' rows of features, and its quality."""
    docs = [(x, q) for x, q in docs if len(x)]
    if len({q for _, q in docs}) < 2:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    chains = Chains(docs)
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    m1, m2 = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, steps + 1):
        _, by_w, by_t = likelihood(w, t, chains)
        grad = ridge * np.concatenate([w, t.ravel()]) - np.concatenate([by_w, by_t.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:N_FEATURES], t - move[N_FEATURES:].reshape(2, 2)
    return Field(w, t)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lines = (batch.column(0)[k].as_py() or "").split("\n")
            rows = features(lines, textstats.repeated_lines(lines)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.float64())), batch.column(1).slice(k, 1)], ["rows", "quality"])


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_quality: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Field:
    """Field trained on labelled documents; `labels` has doc_id and quality."""
    chosen = None
    for quality in (0, 1):
        ids = labels.where(F.col("quality") == quality).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_weft_id"), F.lit(quality).alias("quality"))
        ids = ids.distinct().orderBy(F.xxhash64("_weft_id"), "_weft_id").limit(per_quality)
        chosen = ids if chosen is None else chosen.unionAll(ids)
    # At most 2 x per_quality ids: bounded
    texts = docs.select(F.col(id_col).cast("long").alias("_weft_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_weft_id")
    texts = texts.dropDuplicates(["_weft_id", "quality"]).withColumn("lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
    first = Window.partitionBy("quality").orderBy(F.xxhash64("_weft_id"), "_weft_id")
    texts = texts.withColumn("sum", F.sum("lines").over(first)).where(F.col("sum") <= lines).select("text", "quality")
    rows = common.mapped(texts, _line_rows, "rows array<double>, quality int").toArrow()
    return trained([(x.values.to_numpy().reshape(-1, N_FEATURES), q) for x, q in zip(rows.column(0), rows.column(1).to_pylist(), strict=True)])


def verdict(text: str, field: Field) -> tuple:
    """The values of VERDICT."""
    lines = text.split("\n")
    again = textstats.repeated_lines(lines)
    words = textstats.split_words(text)
    n = len(words)
    repeats = textstats.repeated_words(textstats.word_hashes(words))
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    found = field.viterbi(features(lines, again))
    in_line = [len(textstats.split_words(x)) for x in lines] if any(found) else []
    share = 1 - sum(k for k, label in zip(in_line, found, strict=False) if label) / n if n else 0.0
    return n, textstats.word_chars(text), textstats.symbols(text), sum(again), repeats, failed, share, not failed and share >= CONTENT_SHARE


TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
NAMES = [x.split(" ")[0] for x in VERDICT.split(", ")]


def _judge(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("words", textstats.forget)
        for batch in batches:
            if batch.num_rows:
                rows = [verdict(x or "", field) for x in batch.column(1).to_pylist()]
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *NAMES])

    return run


def judged(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the columns of VERDICT."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(docs, _judge(field), f"doc_id long, {VERDICT}")


def _keep(at: int, field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("words", textstats.forget)
        for batch in batches:
            yield batch.filter(pa.array([verdict(x or "", field)[-1] for x in batch.column(at).to_pylist()], pa.bool_()))

    return run


def kept_rows(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    return common.mapped(docs, _keep(docs.columns.index(text_col), field), docs.schema)
