import glob
import os

import duckdb
import pytest

import corpus_pipeline
from weft.llm import common, line_rules, secrets
from weft.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

from test_near_words import brute_words

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    relation = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    order = [relation.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=str)


def test_stages_against_brute_force(spark):
    """Each stage's rows, and the whole of run(), from plain Python over the collected documents."""
    from weft.llm.packing import encoder

    docs = common.table(spark, DIR, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    field = line_rules.learned(docs, common.table(spark, DIR, "labels"))
    kept = {i for i, r in rows.items() if line_rules.verdict(r.text or "", field)[-1]}
    out = docs
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    out = common.written(stage["quality rules"](spark, out, DIR), "t1")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    best = {}
    for i in sorted(kept):
        best[rows[i].text.encode().lower()] = i
    out = common.written(stage["exact dedup"](spark, out, DIR), "t2")
    assert {r.doc_id for r in out.collect()} == set(best.values())
    near = brute_words([(i, rows[i].text) for i in sorted(best.values())], corpus_pipeline.NEAR_WORDS)
    out = common.written(stage["near dedup"](spark, out, DIR), "t3")
    assert {r.doc_id for r in out.collect()} == near
    limits = secrets.learned(secrets.scanned(out))
    texts = {i: secrets.redacted_text(rows[i].text, limits) for i in near}
    out = common.written(stage["secret scans"](spark, out, DIR), "t4")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in texts.items()} and out.columns == docs.columns
    tokens = encoder(tokenizer_file("byte_bpe_50k.json")).tokenizer
    sizes = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    last = stage["packing"](spark, out, DIR)
    totals = {}
    for r in last.collect():
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == sizes
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DIR)) == key(last)


def test_empty_and_odd_documents(spark, docs, edge_rows):
    for table in (docs([]), docs(edge_rows)):
        out = table
        for name, f in corpus_pipeline.STAGES:
            out = common.written(f(spark, out, DIR), "t")
            assert name == "packing" or out.columns == table.columns
        assert out.count() >= 0
