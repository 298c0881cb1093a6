"""Joins beyond the bound of broadcasts, scratch tables, and pieces of rows that repeat an id or have none."""

import gc
import os
import weakref
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers

from weft.llm import common, exact_dedup, near_dedup, packing, textstats, warc_zip

from test_near_dedup import brute, corpus

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def equal_texts(rows):
    """(doc_id, keep_id, group_size) by grouping in Python; a null id is the least."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return Counter((i, best[(t or "").encode().lower()], len(groups[(t or "").encode().lower()])) for i, t in rows)


def pieces(rows):
    tokenizer = packing.encoder(TOKENIZER).tokenizer
    out = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for at in range(0, len(ids), packing.SIZE):
            part = ids[at : at + packing.SIZE]
            out[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    return out


def test_nothing_is_broadcast(spark, docs, edge_rows, monkeypatch):
    """With a bound of no rows every join shuffles, and results are the same."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [*edge_rows, *[(100 + i, t) for i, t in corpus(6)]]
    found = exact_dedup.exact_dedup(docs(rows))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == equal_texts(rows)
    assert len(exact_dedup.keep_one(docs(rows)).collect()) == len({(t or "").encode().lower() for _, t in rows})
    near = near_dedup.near_dedup(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near), key=str) == brute(rows)
    packed = packing.packed(docs(rows), TOKENIZER).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == pieces(rows)
    pages = spark.createDataFrame([(k, "u", f"page {k % 4}") for k in range(20)], "page_id long, url string, html string")
    read = warc_zip.read_archives(warc_zip.write_archives(pages)).collect()
    assert sorted((r.page_id, r.refers_to) for r in read) == [(k, k % 4 if k >= 4 else None) for k in range(20)]


def test_pieces_of_repeated_and_missing_ids(docs, edge_rows):
    """Every row's ids, those of rows with one id or none among them; sequences are full of them without gaps."""
    rows = [*edge_rows, (6, "another text of six"), (None, "x y z " * 3000), (None, "a text without an id")]
    found = packing.packed(docs(rows), TOKENIZER).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == pieces(rows)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE


def tables(spark):
    root = Path(common.scratch.shared_dir(spark).removeprefix("file://")) / "weft"
    return set(os.listdir(root)) if root.exists() else set()


def test_scopes_delete_what_is_not_kept(spark, docs):
    before = tables(spark)
    with common.scope() as outer:
        with common.scope() as keep:
            one, two = common.written(spark.range(3), "one"), common.written(spark.range(3), "two")
            keep(one)
        assert len(tables(spark) - before) == 1 and one.count() == 3 and two is not None
        outer()
    assert tables(spark) == before
    near_dedup.near_dedup(docs(corpus(2))).collect()
    assert {x.rsplit("-", 1)[0] for x in tables(spark) - before} == {"near-labels", "near-best"}


def test_forgotten_caches_are_freed():
    """An encoder and its words refer to each other; they go when another owner's task begins, without waiting for the collector."""
    gc.collect()
    gc.disable()
    try:
        common.remembering("packing", packing.forget)
        seen = weakref.ref(packing.encoder(TOKENIZER))
        assert seen()("some words") and seen() is not None
        common.remembering("words", textstats.forget)
        assert seen() is None
    finally:
        gc.enable()


def test_few_files_of_many_partitions(spark, docs, monkeypatch):
    """Tables on the way of near dedup don't get a file for every partition of a shuffle."""
    files, write = {}, common.written

    def written(df, name):
        out = write(df, name)
        files[name] = max(len(out.inputFiles()), files.get(name, 0))
        return out

    rows = corpus(1)
    monkeypatch.setattr(common, "written", written)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = near_dedup.near_dedup(docs(rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows)
    most = 2 * spark.sparkContext.defaultParallelism
    few = {"near-nodes", "near-shared", "near-members", "near-used", "near-sets", "near-rooted", "near-mixed", "near-roots", "near-labels", "near-best", "links"}
    assert {n for n in few if files[n] > most} == set() and few <= set(files)
