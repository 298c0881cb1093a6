"""Features of lines from their whole length."""

import random
from itertools import product

import numpy as np
import pyarrow as pa

from weft.llm import line_rules, textstats

UPPER = 8


def test_capitals_count_over_the_whole_line():
    prose, shouting = "plain words go on and on. " * 20, "SHOUTED WORDS GO ON AND ON! " * 60
    for line in (prose + shouting, shouting + prose, "É" * 500 + "é" * 700):
        assert line_rules.features([line], [False])[0, UPPER] == sum(c.isupper() for c in line) / len(line)


def test_capitals_are_those_of_isupper():
    rng = random.Random(8)
    for _ in range(300):
        line = "".join(rng.choice("aZ 9É漢ǅİßΩ\U0001d400Ⓐ") for _ in range(rng.randint(0, 900)))
        assert line_rules.capitals(line) == sum(c.isupper() for c in line)


def test_training_takes_all_lines_of_a_text():
    """A repeated line counts as such by what stands anywhere before it."""
    lines = [f"Line {k} has words of its own." for k in range(300)] + ["HOME | NEXT | MENU"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)]), pa.array([0], pa.int32())], ["text", "quality"])
    (out,) = line_rules._line_rows(iter([batch]))
    rows = np.array(out.column(0)[0].as_py()).reshape(-1, line_rules.N_FEATURES)
    assert rows[:, 2].tolist() == [float(k > 300) for k in range(600)]
    assert line_rules.Chains([(rows, 0)]).lengths.tolist() == [256, 256, 88]


def enumerated(w, t, docs):
    """Log-likelihood by all labellings of every text."""
    total = 0.0
    n = [sum(q == k for _, q in docs) for k in (0, 1)]
    for x, quality in docs:
        scores = {}
        for labels in product((0, 1), repeat=len(x)):
            scores[labels] = sum(row @ w for row, label in zip(x, labels, strict=True) if label) + sum(t[a, b] for a, b in zip(labels, labels[1:], strict=False))
        z = np.log(sum(np.exp(v) for v in scores.values()))
        agree = [v for labels, v in scores.items() if any(labels) != bool(quality)]
        total += 0.5 / n[quality] * (np.log(sum(np.exp(v) for v in agree)) - z)
    return total


def test_likelihood_and_gradient_by_enumeration():
    rng = np.random.default_rng(4)
    docs = [(rng.normal(size=(n, line_rules.N_FEATURES)), q) for n, q in ((1, 0), (3, 1), (6, 0), (2, 1), (5, 0), (1, 1))]
    chains = line_rules.Chains(docs)
    for _ in range(5):
        w, t = rng.normal(size=line_rules.N_FEATURES), rng.normal(size=(2, 2))
        value, by_w, by_t = line_rules.likelihood(w, t, chains)
        assert abs(value - enumerated(w, t, docs)) < 1e-9
        step = 1e-5
        for k in range(line_rules.N_FEATURES):
            move = np.eye(line_rules.N_FEATURES)[k] * step
            assert abs((enumerated(w + move, t, docs) - enumerated(w - move, t, docs)) / (2 * step) - by_w[k]) < 1e-6
        for k in range(4):
            move = np.eye(4)[k].reshape(2, 2) * step
            assert abs((enumerated(w, t + move, docs) - enumerated(w, t - move, docs)) / (2 * step) - by_t.ravel()[k]) < 1e-6


def test_lines_within_mixed_texts():
    """Only documents are labelled; bad ones mix menus and shouts with prose. The lines are told apart, and the share of content decides."""
    rng = random.Random(5)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + "."
    menu = lambda: " | ".join(rng.choices(words, k=rng.randint(4, 8)))
    shout = lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=rng.randint(4, 8)))

    def mixed(bad, good):
        lines = [(rng.choice((menu, shout))(), 1) for _ in range(bad)] + [(prose(), 0) for _ in range(good)]
        rng.shuffle(lines)
        return [x for x, _ in lines], [y for _, y in lines]

    rows = lambda lines: line_rules.features(lines, textstats.repeated_lines(lines))
    docs = [(rows([prose() for _ in range(rng.randint(2, 9))]), 1) for _ in range(80)] + [(rows(mixed(rng.randint(1, 5), rng.randint(0, 6))[0]), 0) for _ in range(80)]
    field = line_rules.trained(docs)
    wrong = total = 0
    for bad, good in ((8, 2), (2, 8), (5, 5), (9, 1), (1, 9)) * 4:
        lines, labels = mixed(bad, good)
        found = field.viterbi(rows(lines))
        wrong, total = wrong + sum(a != b for a, b in zip(found, labels, strict=True)), total + len(lines)
        values = line_rules.verdict("\n".join(lines), field)
        share, kept = values[-2:]
        content = sum(len(x.split()) for x, y in zip(lines, labels, strict=True) if not y)
        if found == labels:
            assert 0 < share < 1 and abs(share - content / sum(len(x.split()) for x in lines)) < 1e-9 and kept == (share >= 0.5)
    assert wrong <= total // 50
