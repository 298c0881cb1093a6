"""License scans: MinHash bands over overlapping windows of text retrieve templates, containment of shingles verifies them.

Words are lower-cased runs of letters and digits; shingles are `SHINGLE` words. Windows of 8, 16, 32, ... shingles overlap by half, so a template of n
shingles lies whole in a window of at most 4n (8 for the shortest). A window's samples are the minima of `BANDS` permuted hashes; each is a band of one row,
and a template is retrieved when it shares a band with a window of its size. Where `SHARE` of a template's shingles stand in the window, their
Jaccard similarity is at least 0.8 / 8, so no band is shared with probability below 0.9 ** 128 = 1.4e-6, and below 4e-12 from 2 shingles on.

Retrieved templates are verified: a match has at least `SHARE` of the template's distinct shingles in the window. Matches of a template in windows that
touch are one; it spans from the first to the last matching shingle.

Scale: the templates' bands go to every task (their number is fixed by the caller); texts are read once and nothing is shuffled.

Edge cases: very long texts are scanned whole, window by window; null and empty texts, and texts shorter than a shingle, have no match; a null doc_id stays null; repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored. Templates shorter than a shingle are refused. Where two templates have the same text both match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textstats

SHINGLE = 5
SHARE = 0.8
BANDS = 128
BLOCK = 4

# Notices and statements of common licenses.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-statement": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
}

WORD = re.compile(r"[^\W_]+")

_rng = np.random.default_rng(23)
_MUL = (_rng.integers(1, 1 << 32, BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint64).astype(np.uint32)[:, None]


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's runs of `SHINGLE` words, in order."""
    words = WORD.findall(text.lower())
    return textstats.windows(textstats.word_hashes([w.encode("utf-8", "surrogatepass") for w in words]), SHINGLE)


def permuted(found: np.ndarray) -> np.ndarray:
    """A row of 32-bit hashes per band."""
    v = (found >> np.uint64(32)).astype(np.uint32)[None] * _MUL
    v += _ADD
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x2C1B3C6D)
    return v


class Templates:
    """Templates by band and level; level k has windows of 2 blocks of BLOCK * 2**k shingles."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = [np.unique(shingles(texts[n])) for n in self.names]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {SHINGLE} words or more")
        self.levels: dict[int, list[int]] = {}
        for t, name in enumerate(self.names):
            level, n = 0, len(shingles(texts[name]))
            while BLOCK << level < n:
                level += 1
            self.levels.setdefault(level, []).append(t)
        self.bands, self.bits = {}, {}
        for level, own in self.levels.items():
            samples = np.stack([permuted(self.sets[t]).min(1) for t in own])
            self.bands[level] = samples
            bits = np.zeros((BANDS, 1 << 12), bool)
            for row in samples:
                bits[np.arange(BANDS), row & 0xFFF] = True
            self.bits[level] = bits

    def retrieved(self, found: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, end) of windows that share a band with it."""
        n = len(found)
        if not n:
            return
        size = -(-n // BLOCK)
        minima = np.full((BANDS, size), 0xFFFFFFFF, np.uint32)
        for lo in range(0, n, 1024):
            v = permuted(found[lo : lo + 1024])
            if v.shape[1] % BLOCK:
                v = np.concatenate([v, np.full((BANDS, BLOCK - v.shape[1] % BLOCK), 0xFFFFFFFF, np.uint32)], 1)
            k = v.shape[1] // BLOCK
            minima[:, lo // BLOCK : lo // BLOCK + k] = v.reshape(BANDS, k, BLOCK).min(2)
        for level in range(max(self.levels) + 1):
            if level in self.levels:
                # A window is a block and the next one; the last block stands alone
                windows = minima.copy()
                np.minimum(windows[:, :-1], minima[:, 1:], windows[:, :-1])
                maybe = np.take_along_axis(self.bits[level], (windows & np.uint32(0xFFF)).astype(np.int64), 1).any(0)
                width = BLOCK << level
                for w in np.flatnonzero(maybe).tolist():
                    for t, sample in zip(self.levels[level], self.bands[level], strict=True):
                        if (windows[:, w] == sample).any():
                            yield t, w * width, min(n, (w + 2) * width)
            if minima.shape[1] % 2:
                minima = np.concatenate([minima, np.full((BANDS, 1), 0xFFFFFFFF, np.uint32)], 1)
            minima = np.minimum(minima[:, ::2], minima[:, 1::2])

    def matches(self, found: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, last shingle, containment) of verified matches; touching ones are joined."""
        out: dict[int, list[list]] = {}
        for t, lo, hi in self.retrieved(found):
            own = self.sets[t]
            at = np.flatnonzero(np.isin(found[lo:hi], own)) + lo
            share = len(np.unique(found[at])) / len(own)
            if share >= SHARE:
                before = out.setdefault(t, [])
                if before and at[0] <= before[-1][1] + SHINGLE:
                    before[-1] = [min(before[-1][0], int(at[0])), max(before[-1][1], int(at[-1])), max(before[-1][2], share)]
                else:
                    before.append([int(at[0]), int(at[-1]), share])
        return [(t, *m) for t in sorted(out) for m in out[t]]


def found_in(text: str, templates: Templates) -> list[tuple[str, int, int, float]]:
    """(license, start, end, containment), start and end in code points, end exclusive."""
    hits = templates.matches(shingles(text))
    if not hits:
        return []
    # Lower-casing may change a text's length, so places come from the words' order in the text itself
    places = [m.span() for m in WORD.finditer(text)]
    same = len(text.lower()) == len(text)
    places = places if same else _places(text)
    return [(templates.names[t], places[a][0], places[b + SHINGLE - 1][1], share) for t, a, b, share in hits]


def _places(text: str) -> list[tuple[int, int]]:
    """Words of the lower-cased text, placed in the text."""
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def _scan(texts: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts)
        for batch in batches:
            rows = [(doc, *hit) for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in found_in(value.as_py() or "", templates)]
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "license", "start", "end", "containment"])

    return run


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, start, end (code points), containment."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(docs, _scan(templates or TEMPLATES), "doc_id long, license string, start long, end long, containment double")
