"""Random keys glued to names, paths and other symbols."""

import random
import string

import pytest

from weft.llm import secrets

KEY = "auA00zT2X7MRkbKXH3bQjoLnjLWv9uFh"
GLUED = [f"sig={KEY}", f"AccountKey={KEY}==", f"a=b={KEY}", f"api/v1/user_files/{KEY}", f"my_dir/{KEY}", f"a-b/{KEY}", f"x+y-{KEY}/z", f"{KEY}=on", f"={KEY}"]


@pytest.mark.parametrize("run", GLUED)
def test_a_part_of_the_run_is_tested(run):
    found = [(run[r["start"] : r["end"]], r["bin"]) for r in secrets.candidates(run, secrets.base_spans(run))]
    assert any(KEY in span and b > secrets.p_bin(0.01) for span, b in found)
    assert secrets.redacted_text(f"see {run} here", {r["class"]: secrets.p_bin(0.001) for r in secrets.candidates(run, [])}).count(KEY) == 0


def test_runs_of_one_alphabet_stay_whole():
    for run in (KEY, KEY + "==", f"ab/{KEY}", f"ab_{KEY}"):
        assert [(r["start"], r["end"]) for r in secrets.candidates(run, [])] == [(0, len(run))]
    assert secrets.candidates("a=" + "b" * 19 + "=c", []) == []


def test_parts_beside_a_base_span():
    text = f"auth={KEY}=token=abcdefgh"
    base = secrets.base_spans(text)
    assert [text[r["start"] : r["end"]] for r in secrets.candidates(text, base)] == [KEY]


def test_parts_by_plain_splitting():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice([*"=+/_-", *["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(1, 30)))] * 3]) for _ in range(12))
        run = text.rstrip("=")
        if len(run) < 20 or secrets.encoding(run):
            continue
        expected = set()
        for foreign in ("=_-", "=+/", "=+/_-"):
            at = 0
            for piece in "".join("\0" if c in foreign else c for c in run).split("\0"):
                if len(piece) >= 20:
                    expected.add((at, piece))
                at += len(piece) + 1
        assert {(s, x) for s, _, x in secrets.parts(text, 0, len(text))} == expected


def test_spans_of_glued_keys(docs):
    rows = [(1, f"open https://h.example?sig={KEY}== now"), (2, f"get my_dir/{KEY} now"), (3, f"put x+y-{KEY}/z now"), (4, "an_ordinary/path-of/words_and=values here")]
    out = {r.doc_id: [dict(rows)[r.doc_id][s.start : s.end] for s in r.found] for r in secrets.secret_spans(docs(rows)).collect()}
    assert all(len(out[i]) <= 2 and any(KEY in x for x in out[i]) for i in (1, 2, 3)) and out[4] == []
    assert not any(KEY in r.text for r in secrets.redact(docs(rows)).collect())
