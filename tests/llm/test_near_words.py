"""Near-duplicates by runs of other than two words, and the pipeline's stage, which takes five."""

import random
import re

import corpus_pipeline
from weft.llm import common, near_dedup

from test_near_dedup import corpus

DIR = "/root/testdata/sf0.001"


def brute_words(rows, size, percent=80):
    """Ids that stay if documents are linked by their runs of `size` words; of a shorter text, by its whole sequence."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    least = {i: i for i, _ in rows}
    for (i, _), a in zip(rows, sets, strict=True):
        for (j, _), b in zip(rows, sets, strict=True):
            if i != j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = least[i], least[j]
                least = {k: min(x, y) if v in (x, y) else v for k, v in least.items()}
    return {i for i, v in least.items() if i == v}


def scattered(changes, seed=9):
    """A text of 200 words, and one with so many of its words changed, none next to another."""
    rng = random.Random(seed)
    words = [f"u{k}" for k in range(200)]
    other = list(words)
    for k in rng.sample(range(8, 192, 8), changes):
        other[k] = f"new{k}"
    return [(1, " ".join(words)), (2, " ".join(other))]


def test_shingle_size_reaches_every_step(docs):
    """11 changed words of 200 leave a similarity of 0.80 by two words and 0.56 by five."""
    rows = scattered(11)
    kept = lambda size: {r.doc_id for r in near_dedup.keep_one(docs(rows), shingle=size).collect()}
    assert kept(2) == brute_words(rows, 2) == {1}
    assert kept(5) == brute_words(rows, 5) == {1, 2}
    rows = [*scattered(3), (3, "one two three"), (4, "one TWO three"), (5, "one two four"), *[(i + 10, t) for i, t in corpus(4)]]
    assert {r.doc_id for r in near_dedup.keep_one(docs(rows), shingle=5).collect()} == brute_words(rows, 5)


def test_near_stage_takes_five_words(spark, docs):
    """Against a five-word brute force: on all documents, and on two that only runs of two words would link."""
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    table = common.table(spark, DIR, "documents")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert {r.doc_id for r in stage(spark, table, DIR).collect()} == brute_words(rows, 5)
    assert {r.doc_id for r in stage(spark, docs(scattered(11)), DIR).collect()} == {1, 2}
