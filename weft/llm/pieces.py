"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are its characters. An agenda, ordered by score and then from the left, holds the adjacent pairs that make a
piece of the vocabulary; the best is merged and its new neighbours join the agenda. Symbols without a piece fall back to bytes.

No merge crosses a pair of neighbouring characters that no piece contains side by side. Texts are cut there (for these
vocabularies: before spaces, around newlines, mostly between letters and signs), and the ids of each unit are remembered, up
to `UNITS_KEPT` a worker. In every Arrow batch, each newly met unit is encoded by the sentencepiece library too, and a
difference is an error. Decoding is the library's.

Edge cases: a null text counts as empty and has the end id alone; a null doc_id stays null; rows that repeat are encoded each; an
empty table gives an empty result; other columns are ignored. A very long word is a long unit: the agenda takes n log n steps.
Vocabularies with user-defined or unused pieces, other types, or a normaliser that rewrites text are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNITS_KEPT = 500_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: types of pieces
SHORT = 40  # symbols up to which the agenda is a list, not a heap
NEVER = float("-inf")
BPE = 2  # fixed value: the model type


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces, scores and flags of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(next((fields(v) for k, v in model if k == 2), ()))
        normalizer = dict(next((fields(v) for k, v in model if k == 3), ()))
        if trainer.get(3, 1) != BPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("a merge-type vocabulary without text normalisation is needed")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(dict(fields(v)) for k, v in model if k == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == NORMAL:
                self.scores[text], self.ids[text] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], i
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind != CONTROL:
                raise ValueError(f"piece {text!r} has a type that is not supported")
        self.pairs = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        self.spaced = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.lined = not any("\n" in p for p in self.pairs)

    def merged(self, unit: str) -> list[str]:
        """Symbols of a unit after all merges."""
        n = len(unit)
        symbols: list[str] = list(unit)
        if n <= SHORT:
            # A short agenda is a list beside the symbols: its first maximum is the best pair, leftmost among equals.
            score = self.scores.get
            agenda = [score(unit[i : i + 2], NEVER) for i in range(n - 1)]
            while agenda and (best := max(agenda)) != NEVER:
                i = agenda.index(best)
                x = symbols[i] = symbols[i] + symbols.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = score(symbols[i - 1] + x, NEVER)
                if i < len(agenda):
                    agenda[i] = score(x + symbols[i + 1], NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.scores.get
        agenda = [(-s, i, i + 1, n2) for i in range(n - 1) if (s := score(n2 := unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, text = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(text):
                continue  # one of the two has been merged since
            symbols[a], symbols[b] = text, ""
            after[a] = c = after[b]
            if c >= 0:
                before[c] = a
                if (s := score(x := text + symbols[c])) is not None:
                    heapq.heappush(agenda, (-s, a, c, x))
            c = before[a]
            if c >= 0 and (s := score(x := symbols[c] + text)) is not None:
                heapq.heappush(agenda, (-s, c, a, x))
        return [x for x in symbols if x]

    def unit_ids(self, unit: str) -> list[int]:
        symbols, out = self.merged(unit), []
        try:
            return [self.ids[x] for x in symbols]
        except KeyError:
            pass
        for symbol in symbols:
            if (i := self.ids.get(symbol)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def units(self, text: str) -> Iterator[str]:
        """Cut where no piece has the two neighbouring characters side by side."""
        start = 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in self.pairs:
                yield text[start:k]
                start = k
        if text:
            yield text[start:]


class _Memory(dict):
    """Ids and their decimal text by word; `prefix` stands before the word."""

    def __init__(self, codec: Codec, prefix: str):
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        unit, v = self.prefix + word, self.codec.vocabulary
        ids = v.unit_ids(unit) if len(unit) <= 24 else [i for u in v.units(unit) for i in v.unit_ids(u)]
        out = tuple(ids), "".join(f"{i} " for i in ids)
        self.codec.fresh.append((unit, out[0]))
        if len(self) < UNITS_KEPT:
            self[word] = out
        return out


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        self.fresh: list[tuple[str, tuple[int, ...]]] = []
        self.after, self.inner = _Memory(self, SPACE), _Memory(self, "")
        self.by_unit = bool(self.vocabulary.spaced and self.vocabulary.lined and self.vocabulary.prefix)

    def encoded(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same as decimals with a space between."""
        v = self.vocabulary
        found: list[tuple[tuple[int, ...], str]] = []
        if not text:
            pass
        elif not self.by_unit:
            found.append(self.inner[v.prefix + text.replace(" ", SPACE)])
        else:
            after, newline = self.after, self.inner["\n"]
            plain = "  " not in text and text[0] != " " and SPACE not in text
            for k, line in enumerate(text.split("\n")):
                if k:
                    found.append(newline)
                if plain:
                    words = line.split(" ")
                    if not k:
                        found += [after[w] for w in words]
                    else:
                        if words[0]:
                            found.append(self.inner[words[0]])
                        found += [after[w] for w in words[1:]]
                else:
                    spaced = ("" if k else SPACE) + line.replace(" ", SPACE)
                    found += [self.inner[u] for u in SPACED.findall(spaced)]
        ids = list(chain.from_iterable([x[0] for x in found]))
        ids.append(self.end)
        return ids, "".join([*[x[1] for x in found], str(self.end)])

    def checked(self) -> None:
        """Encode by the library what is new since the last call, and compare: every unit, joined by what keeps them apart.

        A word after one space is compared after a space, any other unit (a line's first word, several spaces and what follows them) on a line of its own.
        """
        prefix, fresh, self.fresh = self.vocabulary.prefix, self.fresh, []
        if not self.by_unit:
            for unit, ids in fresh:
                self.same([unit], list(ids), self.library.encode(unit[len(prefix) :].replace(SPACE, " "), num_threads=1))
            return
        spaced = [x for x in fresh if x[0].startswith(SPACE) and SPACE not in x[0][1:] and len(x[0]) > 1]
        known = {u for u, _ in spaced}
        other = [x for x in fresh if x[0] not in known and x[0] not in ("", "\n")]
        # The library puts a space sign first; a unit without one follows a newline.
        newline = self.library.encode("\n")
        self.same(["\n"], list(self.inner["\n"][0]), newline[1:])
        if spaced:
            ids = chain.from_iterable([x for _, x in spaced])
            self.same([u for u, _ in spaced], list(ids), self.library.encode(" ".join(u[1:] for u, _ in spaced), num_threads=1))
        if other:
            ids = newline + [i for k, (_, own) in enumerate(other) for i in ((*newline[1:], *own) if k else own)]
            self.same([u for u, _ in other], ids, self.library.encode("\n" + "\n".join(u.replace(SPACE, " ") for u, _ in other), num_threads=1))

    @staticmethod
    def same(units: list[str], ours: list[int], theirs: list[int]) -> None:
        if ours != theirs:
            raise ValueError(f"the library encodes one of {len(units)} new units otherwise, from {units[0][:50]!r} to {units[-1][:50]!r}")


SPACED = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def forget() -> None:
    _codecs.clear()


def _run(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("pieces", forget)
        own = codec(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                both = [own.encoded(x or "") for x in part.column(1).to_pylist()]
                own.checked()
                decoded = own.library.decode([ids for ids, _ in both], num_threads=1)
                counts = pa.array([len(ids) for ids, _ in both], pa.int64())
                if digests:
                    yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array([sha(x) for _, x in both]), pa.array(list(map(sha, decoded)))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array([ids for ids, _ in both], pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, model: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and decoded; with `digests` their SHA-256 instead, which spares moving them."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return common.mapped(docs, _run(model, digests), schema)
