"""Secret scans: fixed patterns plus a randomness test battery.

Base spans: `assign`, `access` and `hex` patterns. The battery looks at every run of 20 or more characters of the base64
alphabets. It infers the encoding, and tests whether the run may be random in it: chi-squared uniformity of the alphabet,
a runs test about the middle of the alphabet, and the serial correlation of neighbouring symbols. Fisher's method combines
the three. Ordinary words fail these tests, keys pass them.

A run that no alphabet holds, as with a name glued to its value by '=' or with '/' beside '_', is cut where base64, base64url or letters and digits
alone end; every part of 20 or more symbols is tested, and of random parts within each other the longest is the span.

A discovery is a secret: a run is taken to be ordinary text unless it looks too random for that. How random ordinary runs look is measured on `surrogates`, runs of
the same encoding and length that are glued from words as identifiers, slugs, paths and compounds are: one from each document's own words, at a place that a hash of
its whole text gives, and `FIXED_NULLS` a class from common words, so that small corpora have some. A run's p-value is the share of its class's surrogates that look as random
or more. Within each class of encoding and length the Benjamini-Hochberg rule accepts runs as secrets so that a share of `FDR` of them is false at most; long runs and short ones, for
which the tests have different power, so have their own thresholds, and short runs are secrets only where there are many. What is accepted is a span of kind `random`, unless it
meets a base span. Thresholds come from counts over all documents in fixed bins, so what reaches the driver is bounded by the number of bins.

Edge cases: very long texts are scanned whole; runs of equal p share a bin and a verdict; null and empty texts have no spans; a null doc_id stays null; repeated rows are scanned each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTS = tuple(re.compile(f"[A-Za-z0-9{more}]{{20,}}") for more in ("+/", "_-", ""))
OWN_WORDS = re.compile(r"[A-Za-z]{2,12}")
WORDS = re.compile(rb"passw|secret|token|api_?key")
FDR = 0.05
FIXED_NULLS = 500
LENGTHS = (24, 28, 32, 40, 48, 64, 96, 128, 256)
P_BINS = 400
P_DECADES = 20

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
NAMES = tuple(ENCODINGS)
RANKS = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
DIGIT_SET = frozenset(DIGITS)
VOWELS = "aeiouAEIOU"
CLASSES = {name: [own for kind in (DIGITS, LOWER, UPPER, "+/-_") if (own := frozenset(kind) & frozenset(alphabet))] for name, alphabet in ENCODINGS.items()}
#: Classes with vowels apart; of each symbol its place in either.
SOUNDS = {name: [part for own in found for part in (own & frozenset(VOWELS), own - frozenset(VOWELS)) if part] for name, found in CLASSES.items()}
CLASS_OF = {name: {c: i for i, own in enumerate(found) for c in own} for name, found in CLASSES.items()}
SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as index of KINDS, end), in order."""
    found = []
    data = text.encode("utf-8", "surrogatepass").lower() if not text.isascii() else text.lower().encode()
    if WORDS.search(data):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding(run: str) -> str | None:
    """The smallest alphabet that has all symbols of the run, and of whose letters and digits the run has both."""
    symbols = frozenset(run)
    mixed = bool(symbols & DIGIT_SET) and bool(symbols - DIGIT_SET)
    return next((name for name, own in SETS.items() if symbols <= own and (mixed or len(own) > 36)), None)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x), by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return scale * h


def chi2_p(statistic: float, freedom: int) -> float:
    return _upper_gamma(freedom / 2, statistic / 2)


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _uniform(counts: list[int], expected: list[float]) -> float:
    return chi2_p(sum((c - e) ** 2 / e for c, e in zip(counts, expected, strict=True)), len(counts) - 1)


def _changes(places: list[int], shares: list[float]) -> float:
    """Runs of classes: how often neighbours differ, against independent draws with these shares."""
    n, s2, s3 = len(places), sum(p * p for p in shares), sum(p**3 for p in shares)
    seen = sum(p != q for p, q in zip(places, places[1:], strict=False))
    var = (n - 1) * s2 * (1 - s2) + 2 * (n - 2) * (s3 - s2 * s2)
    return normal_p((seen - (n - 1) * (1 - s2)) / math.sqrt(var)) if var > 0 else 1.0


def _serial(xs: list[float], alone: float) -> float:
    """Correlation of neighbours; `alone` is the p-value of a sequence without any spread."""
    n = len(xs)
    mid = sum(xs) / n
    spread = sum((x - mid) ** 2 for x in xs)
    if not spread:
        return alone
    r = sum((p - mid) * (q - mid) for p, q in zip(xs, xs[1:], strict=False)) / spread
    return normal_p((r + 1 / n) * math.sqrt(n))


def battery(run: str, name: str) -> tuple[float, float, float]:
    """P-values of uniformity, runs and serial correlation under randomness in the encoding. Each is of two tests, of which the lesser p counts twice:
    by the symbols' places in the alphabet, and by what words betray themselves with, their classes (digits, cases, signs) and vowels."""
    rank, size = RANKS[name], len(ENCODINGS[name])
    xs = [rank[c] for c in run]
    n = len(xs)
    # The alphabet is cut into cells of about equal size, of which each expects 2.5 symbols or more.
    cells = max(2, min(size, int(n / 2.5)))
    counts, widths = [0] * cells, [0] * cells
    for x in range(size):
        widths[x * cells // size] += 1
    for x in xs:
        counts[x * cells // size] += 1
    sounds = SOUNDS[name]
    by_sound = _uniform([sum(map(run.count, own)) for own in sounds], [n * len(own) / size for own in sounds])
    uniform = min(1.0, 2 * min(_uniform(counts, [n * w / size for w in widths]), by_sound))
    high = [int(2 * x >= size) for x in xs]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = normal_p((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = min(1.0, 2.0 ** (1 - n))
    runs_p = min(1.0, 2 * min(runs_p, _changes([CLASS_OF[name][c] for c in run], [len(own) / size for own in CLASSES[name]])))
    serial_p = min(1.0, 2 * min(_serial(xs, float(size) ** (1 - n)), _serial([c in VOWELS for c in run], 1.0)))
    return uniform, runs_p, serial_p


def random_p(run: str, name: str) -> float:
    """Fisher's combination of the battery."""
    return chi2_p(-2 * sum(math.log(max(p, 1e-290)) for p in battery(run, name)), 6)


def p_bin(p: float) -> int:
    """Bin of a p-value, 0 the smallest; equal steps of the logarithm."""
    return max(0, min(P_BINS - 1, int((math.log10(max(p, 1e-300)) / P_DECADES + 1) * P_BINS)))


def parts(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, symbols to test): the run without its padding, or its parts if no alphabet holds it. Spans have the padding at the run's end."""
    run = text[start:end].rstrip("=")
    if len(run) < 20 or encoding(run):
        return [(start, end, run)] if len(run) >= 20 else []
    stop = start + len(run)
    found = {m.span() for own in PARTS for m in own.finditer(text, start, stop)}
    return [(s, end if e == stop else e, text[s:e]) for s, e in sorted(found)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Runs, or their parts, that no base span meets, with class (encoding and length) and bin of p."""
    found = []
    for m in RUN.finditer(text):
        for start, end, run in parts(text, *m.span()):
            if any(s < end and start < e for s, _, e in base):
                continue
            name = encoding(run)
            found.append({"start": start, "end": end, "class": f"{name}:{bisect(LENGTHS, len(run))}", "bin": p_bin(random_p(run, name))})
    return found


# Common English words, of which fixed surrogates are made.
COMMON = """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their
we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over
man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make
world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used
take three user index name file value config service request handler update index table column buffer session account profile number address content version release""".split()


def surrogate(words: list[str], name: str, length: int, rng: random.Random) -> str:
    """A run of an encoding's symbols that is glued from words, with a number now and then."""
    style, mark, out, k = rng.randrange(3), rng.choice("-_"), "", rng.randrange(len(words))
    while len(out) < length:
        word = words[k % len(words)].lower()
        k += 1
        if name in ("hex", "HEX"):
            word = "".join(LOWER[ord(c) % 6] for c in word)
        if name in ("HEX", "BASE36", "base32"):
            word = word.upper()
        elif style and name.startswith("base6"):
            word = word.title()
        if (style == 2 or not name.startswith("base6")) and rng.random() < 0.3:
            word += str(rng.randrange(10 ** rng.randint(1, 4)))
        out += ({"base64": "/", "base64url": mark}.get(name, "") if out else "") + word
    out = out[:length]
    return out.translate(str.maketrans("0189", "2345")) if name == "base32" else out


def length_of(group: int, rng: random.Random) -> int:
    """Some length of a group of lengths."""
    lows, highs = (20, *LENGTHS), (*LENGTHS, 2 * LENGTHS[-1])
    return rng.randrange(lows[group], highs[group])


def null_run(text: str) -> tuple[str, int] | None:
    """Class and bin of the surrogate from a text's own words; none if these are too few."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    at = seed % (len(text) + 1)
    words = OWN_WORDS.findall(text, at, at + 600)
    if len(words) < 8:
        words = OWN_WORDS.findall(text, max(0, at - 600), at + 600)
    if len(words) < 8:
        return None
    rng = random.Random(seed)
    name, group = rng.choice(NAMES), rng.randrange(len(LENGTHS) + 1)
    run = surrogate(words, name, length_of(group, rng), rng)
    return (f"{name}:{group}", p_bin(random_p(run, name))) if encoding(run) == name else None


@functools.cache
def fixed_nulls(key: str) -> dict[int, int]:
    """Surrogates of a class by bin, from common words."""
    name, group = key.split(":")
    rng, out, tries = random.Random(key), Counter(), 0
    while sum(out.values()) < FIXED_NULLS and tries < 4 * FIXED_NULLS:
        tries += 1
        run = surrogate(COMMON, name, length_of(int(group), rng), rng)
        if encoding(run) == name:
            out[p_bin(random_p(run, name))] += 1
    return dict(out)


def thresholds(counts: dict[tuple[str, int], int], nulls: dict[tuple[str, int], int], rate: float = FDR) -> dict[str, int]:
    """By class the lowest bin whose runs, with those of higher bins, are secrets (`P_BINS`: none are), by the Benjamini-Hochberg rule.

    `counts` has the number of runs by class and bin, and `nulls` that of surrogates. The p-value of a bin is the share of surrogates in it or above, one added.
    """
    out = {}
    for name in {c for c, _ in counts}:
        bins = sorted(((b, n) for (c, b), n in counts.items() if c == name), reverse=True)
        own = sorted(((b, n) for (c, b), n in nulls.items() if c == name), reverse=True)
        total, base, seen, above, k, out[name] = sum(n for _, n in bins), sum(n for _, n in own), 0, 0, 0, P_BINS
        for b, n in bins:
            seen += n
            while k < len(own) and own[k][0] >= b:
                above += own[k][1]
                k += 1
            if (1 + above) / (1 + base) <= seen * rate / total:
                out[name] = b
    return out


SCAN = "doc_id long, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,class:string,bin:int>>, null_class string, null_bin int"
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.string()), ("bin", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, runs, nulls = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            runs.append(candidates(text, base))
            nulls.append(null_run(text) or (None, None))
        own = [pa.array([x for x, _ in nulls], pa.string()), pa.array([x for _, x in nulls], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _BASE), pa.array(runs, _RUNS), *own], ["doc_id", "base", "runs", "null_class", "null_bin"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(docs, _scan, SCAN)


def learned(scan: DataFrame, rate: float = FDR) -> dict[str, int]:
    """Thresholds over all documents of a scan; at most 2 x classes x bins counts reach the driver."""
    runs = scan.select(F.lit(1).alias("found"), F.explode("runs").alias("r")).select("found", "r.class", "r.bin")
    nulls = scan.where("null_class IS NOT NULL").select(F.lit(0), "null_class", "null_bin")
    rows = runs.unionAll(nulls).groupBy("found", "class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["class"], r["bin"]): r["n"] for r in rows if r["found"]}
    null_counts = Counter({(r["class"], r["bin"]): r["n"] for r in rows if not r["found"]})
    for name in {c for c, _ in counts}:
        null_counts.update({(name, b): n for b, n in fixed_nulls(name).items()})
    return thresholds(counts, null_counts, rate)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per document: doc_id, base and found (both arrays of start, kind, end, in order; found has base and random spans)."""
    scan = common.written(scanned(docs, id_col, text_col), "secrets")
    limits = learned(scan, rate)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    runs = F.filter("runs", lambda r: r["bin"] >= limit[r["class"]]) if limits else F.slice("runs", 1, 0)
    # A random part within another random part of the same run is no span of its own.
    runs = F.filter(runs, lambda r: ~F.exists(runs, lambda x: (x["start"] <= r["start"]) & (r["end"] <= x["end"]) & (x["end"] - x["start"] > r["end"] - r["start"])))
    extra = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return scan.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("found"))


def as_text(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted_text(text: str, limits: dict[str, int]) -> str:
    """The text with every span replaced by a mark of its kind; overlapping spans become one mark."""
    base = base_spans(text)
    found = sorted(base + [(r["start"], 3, r["end"]) for r in candidates(text, base) if r["bin"] >= limits.get(r["class"], P_BINS)])
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(at: int, limits: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else redacted_text(x, limits) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """`docs` with all columns and rows, spans of the text replaced by marks. Thresholds are of these documents."""
    limits = learned(scanned(docs, id_col, text_col), rate)
    return common.mapped(docs, _redact(docs.columns.index(text_col), limits), docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
