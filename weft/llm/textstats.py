"""Statistics of texts: words, symbols, repeated lines and repeated word windows."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# What a word's and a symbol's characters are, and the window of repeated words.
BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORDS_KEPT = 150_000
TAIL_BYTES = np.array([(b & 0xC0) == 0x80 for b in range(256)])


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` neighbouring words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    return out


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows that occur twice or more."""
    found = windows(hashes, size)
    if len(found) < 2:
        return 0
    order = np.argsort(found)
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[: len(found)][at] += 1
    np.subtract.at(edges, at + size, 1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def split_words(text: str) -> list[bytes]:
    """Words of the text in UTF-8: bytes.split() splits at exactly the blanks above."""
    return text.encode("utf-8", "surrogatepass").split()


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANKS))


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


HAS_WORD = re.compile(f"[^{BLANKS}]")


def repeated_lines(lines: list[str]) -> list[bool]:
    """Whether a line has a word and equals an earlier one."""
    seen: set[str] = set()
    out = []
    for line in lines:
        again = line in seen
        out.append(again and HAS_WORD.search(line) is not None)
        if not again:
            seen.add(line)
    return out
