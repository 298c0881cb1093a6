"""How many passages of a length in bytes are found, each in two differing contexts; the README's table has these figures."""

import random

import pytest

from weft.llm import substring_dedup

#: Bytes of the passage, share found of 1,000 (to the percent below)
STATED = {112: 0.00, 150: 0.33, 180: 0.80, 200: 0.93, 228: 0.98, 257: 0.99, 291: 1.00, 331: 1.00, 400: 1.00, 600: 1.00}


def prose(rng, size):
    """Just so many bytes of made-up words."""
    out = ""
    while len(out) < size:
        out += "".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(1, 9))) + " "
    return out[: size - 1] + "."


def found(passage, rng):
    """Whether a joined run of spans of the second copy, all of which the first copy has, is long enough."""
    first, second = (f"{prose(rng, rng.randint(60, 300))} {passage} {prose(rng, rng.randint(60, 300))}".encode() for _ in range(2))
    seen, runs = {first[a:b] for a, b in substring_dedup.spans(first)}, []
    for a, b in substring_dedup.spans(second):
        if second[a:b] in seen:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    return any(b - a >= substring_dedup.LEAST for a, b in runs)


def recall(size, n=1000):
    rng = random.Random(size)
    return sum(found(prose(rng, size), rng) for _ in range(n)) / n


@pytest.mark.parametrize("size", STATED)
def test_recall_by_length(size):
    assert 0 <= recall(size) - STATED[size] < 0.01
