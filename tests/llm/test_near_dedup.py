import random
import re

import numpy as np
import pytest

from weft.llm import components, near_dedup


def brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if rng.random() < 0.5 else base  # chains, too
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    found = near_dedup.near_dedup(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_edges(docs, edge_rows):
    found = near_dedup.near_dedup(docs(edge_rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(edge_rows)
    assert sum(r.kept for r in found if r.component_id == 6) == 1
    assert all(r.kept for r in found if r.n_shingles == 0 or r.doc_id is None)
    assert near_dedup.near_dedup(docs([])).count() == 0


def test_chain_links_through_members(docs):
    """Neighbours of a chain are similar, its ends are not."""
    words = [f"v{k}" for k in range(100)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 60])) for k in range(8)]
    found = near_dedup.near_dedup(docs(rows))
    assert {r.component_id for r in found.collect()} == {0}
    assert [r.doc_id for r in near_dedup.keep_one(docs(rows)).collect()] == [0]


def test_repeated_ids_with_different_texts(docs):
    """Of an id's rows only those of a kept set stay, and one of those that repeat id and set."""
    one, two = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, one), (2, one + " end"), (2, two), (2, two), (3, two), (4, ""), (4, None), (None, two)]
    found = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(docs(rows)).collect()), key=str)
    assert found == sorted([(1, one), (2, two), (4, ""), (4, None)], key=str)


def test_ids_by_shuffle(docs, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(near_dedup, "IDS_SENT", 0)
    found = near_dedup.near_dedup(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)


def test_sketches_tell_similarities_apart():
    rng = np.random.default_rng(1)
    close, far = [], []
    for shared, counts in ((800, close), (300, far)):
        for _ in range(60):
            xs = rng.integers(0, 1 << 63, 1000 + 1000 - shared, dtype=np.uint64)
            own = (1000 - shared) // 2
            a, b = xs[: 1000 - own], np.concatenate([xs[: shared], xs[1000 - own : 1000]])
            x = near_dedup.odd_sketch(near_dedup.minhashes(np.unique(a))) ^ near_dedup.odd_sketch(near_dedup.minhashes(np.unique(b)))
            counts.append(bin(int.from_bytes(x.tobytes(), "little")).count("1"))
    assert max(close) <= near_dedup.sketch_limit() < min(far) + 60 and np.mean(close) + 40 < np.mean(far)


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (101, 101), (50, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(1, 31)}, 50: 0, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
