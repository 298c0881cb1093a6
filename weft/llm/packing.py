"""Packing of tokenised documents into sequences of a fixed length, shortest pack first over the length histogram.

A document's ids (its text's ids, then an end id) are cut into pieces of at most `size`. The pieces' lengths are counted; on
the driver, lengths are placed longest first into the pack with the most room left, for all packs of one pattern at
once, so the work depends on the number of lengths and patterns and not on that of documents. Patterns are then joined back to
pieces by rank: the k-th piece of a length takes the k-th slot of that length.

Ranks need no global sort. A piece has its rank among those of its length in the partition that wrote it; adding the counts
of earlier partitions gives the rank in the corpus.

Scale: a histogram has at most `size` rows. A step of the placement either finishes a length or uses up a pattern's packs, so at most 2 x `size` patterns live; their
slots, which go to every task, are bounded by `size` alone. Pieces are shuffled once, without their ids unless these are asked for.

Tokenising: ids are those of the tokenizers library. As its byte-level pre-tokeniser never joins text across a single space or
newline between two other characters, words are encoded once and remembered, up to `WORDS_KEPT` a worker. New words go to
tiktoken's merge loop with the ranks of the same file, which is faster a call. Every word that is remembered is also encoded by tokenizers, and one in
`CHECKED` of those for which there is no room; a difference is an error. Texts with other white space or special tokens go to tokenizers in whole segments.

Edge cases: a very long text is encoded whole, in one task, and cut into as many pieces as it needs; ties between equal lengths go by partition and place, which
decides the sequence and nothing else; a null text counts as empty and yields the end id alone; a null doc_id stays null; rows that repeat are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 2048
END_ID = 1
WORDS_KEPT = 200_000
CHECKED = 64
# Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part int, rank long"


class Irregular(Exception):
    """A word with white space at an end: its neighbours matter."""


class _Words(dict):
    """Bytes of the ids (unsigned 32 bits, little-endian) by word."""

    def __init__(self, owner: Encoder, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular(word)
        room = self.owner.room
        out = self.owner.word(self.prefix + word, check=room > 0)
        if room:
            self[word] = out
            self.owner.room -= 1
        return out


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes of a byte-level vocabulary whose ids follow the order of its merges; None for any other."""
    vocab, merges = model["vocab"], model["merges"]
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(kept))
    signs = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
    if model.get("ignore_merges") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    return {bytes(signs[c] for c in text): i for text, i in vocab.items() if i < 256 + len(pairs)}


class Encoder:
    """Ids of texts as bytes, equal to what the library gives for the whole text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        before = model.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not model.get("normalizer")
        ranks = byte_ranks(model["model"]) if self.by_word else None
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary if ranks else None
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self.newline = self.library("\n") if self.by_word else b""
        self.met, self.room = 0, WORDS_KEPT
        self.first, self.rest = _Words(self, ""), _Words(self, " ")

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str, check: bool) -> bytes:
        self.met += 1
        if self.merge is None:
            return self.library(text)
        out = array("I", self.merge(text)).tobytes()
        if (check or self.met % CHECKED == 1) and out != self.library(text):
            raise ValueError(f"tokenizers and tiktoken differ on {text!r}")
        return out

    def segment(self, text: str) -> bytes:
        words, rest = text.split(" "), self.rest
        try:
            return b"".join([self.first[words[0]], *[rest[w] for w in words[1:]]])
        except Irregular:
            return self.library(text)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(x in text for x in self.special):
            return self.library(text)
        if not text:
            return b""
        # A newline between other characters is a token of its own
        return self.newline.join(map(self.segment, NEWLINE.split(text)))


NEWLINE = re.compile(r"(?<=\S)\n(?=\S)")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remembering("packing", forget)
        encode, part = encoder(path), TaskContext.get().partitionId()
        ranks = [0] * (size + 1)
        for batch in batches:
            docs, starts, lengths, tokens, sums, places, pieces = [], [], [], [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(value.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    k = min(size, n - at)
                    piece = ids[4 * at : 4 * (at + k)]
                    docs.append(doc)
                    starts.append(at)
                    lengths.append(k)
                    tokens.append(n)
                    sums.append(zlib.crc32(piece))
                    places.append(ranks[k])
                    ranks[k] += 1
                    if with_ids:
                        pieces.append(piece)
            long = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, tokens, sums)]
            arrays = [*long, pa.array([part] * len(docs), pa.int32()), pa.array(places, pa.int64())]
            names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pieces, pa.binary())] if with_ids else arrays, [*names, "ids"] if with_ids else names)

    return run


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many packs have each: lengths longest first, each into the pack with the most room."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    most = 0  # no pattern has more room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not by_room[most]:
                most -= 1
            if most >= length:
                pattern, packs = by_room[most].pop()
                n = min(left, packs)
                if n < packs:
                    by_room[most].append((pattern, packs - n))
                room = most - length
            else:
                pattern, n, room = (), left, size - length
            by_room[room].append(((*pattern, length), n))
            most = max(most, room)
            left -= n
    return [x for room in by_room for x in room]


def slots(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For every length its slots in order of rank: (length, first rank) as one key, first sequence, offset in the sequence."""
    rows, taken, sequence = [], {}, 0
    for pattern, packs in found:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset))
            taken[length] = first + packs
            offset += length
        sequence += packs
    rows.sort()
    length, first, sequences, offsets = np.array(rows, np.int64).reshape(-1, 4).T
    return (length << 48) + first, first, sequences, offsets


def _place(table: tuple[np.ndarray, ...]):
    keys, first, sequences, offsets = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            rows = pa.table([*batch.columns, pa.array(sequences[at] + rank - first[at]), pa.array(offsets[at])], [*batch.schema.names, "sequence_id", "offset"])
            yield from rows.drop_columns(["rank"]).to_batches()

    return run


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset; with `with_ids` also ids (unsigned 32 bits, little-endian).

    The table of earlier counts grows with partitions times lengths: it is broadcast only while it is within the bound, else joined by a shuffle on both.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = ", ids binary" if with_ids else ""
    pieces = common.written(common.mapped(docs, _pieces(tokenizer, size, end_id, with_ids), PIECE + extra), "packing")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(common.bounded(counts.drop("n")), ["length", "part"])
    columns = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"), *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + extra + ", sequence_id long, offset long"
    return common.mapped(ranked.select(*columns), _place(slots(patterns(histogram, size))), schema)
