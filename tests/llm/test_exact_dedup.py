import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import exact_dedup
from weft.llm.exact_dedup import QuotientFilter


def test_against_brute_force(docs, edge_rows):
    rows = [*edge_rows, (20, "SAME same TEXT"), (21, "Äpfel"), (22, "äpfel"), (23, "word")]
    found = exact_dedup.exact_dedup(docs(rows)).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    expected = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == expected
    kept = [(r.doc_id, r.text_sha256) for r in found if r.kept]
    assert len(kept) == len(groups) == len(set(kept))  # one of each group, also of rows that repeat their id
    assert all(i == max((x for x in groups[t] if x is not None), default=None) for t in groups for i, h in kept if h == hashlib.sha256(t.encode()).hexdigest())


def test_keep_one(docs, edge_rows):
    table = docs(edge_rows)
    out = exact_dedup.keep_one(table)
    assert out.columns == table.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect() if "same" in (r.text or "")) == [("7", "same same text")]
    assert out.count() == len({t or "" for _, t in edge_rows})
    twice = docs([(1, "a"), (1, "a"), (1, "b")])
    assert sorted(r.text for r in exact_dedup.keep_one(twice).collect()) == ["a", "b"]


def test_empty(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.keep_one(docs([])).count() == 0


def test_routing_beyond_the_bound(docs, edge_rows, monkeypatch):
    expected = sorted(map(str, exact_dedup.exact_dedup(docs(edge_rows)).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "ROUTED_ROWS", 0)
    assert sorted(map(str, exact_dedup.exact_dedup(docs(edge_rows)).drop("kept").collect())) == expected


def test_fingerprint_collisions_lose_nothing(docs, monkeypatch):
    # All fingerprints equal: only byte verification tells texts apart. (In this process: the functions run in workers, so they are called here.)
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "A"])], ["text"])
    out = list(exact_dedup._routed(np.array([5]))(iter([batch])))[0].to_pydict()
    assert out["data"] == [b"a", b"b", b"a"] and len(set(out["text_sha256"])) == 2


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 51), max_size=30), min_size=1, max_size=5))
def test_merging_filters_is_lossless(parts):
    filters = []
    for part in parts:
        keys, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        filters.append(QuotientFilter.load(QuotientFilter.of_sorted(keys, counts).dump()))
    merged = QuotientFilter.merged(filters) if sum(map(len, parts)) else None
    everything = [x for part in parts for x in part]
    if merged:
        assert dict(zip(merged.keys().tolist(), merged.counts.tolist(), strict=True)) == {x: everything.count(x) for x in everything}
