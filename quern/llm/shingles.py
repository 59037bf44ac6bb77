"""Sets of word shingles as sorted 64-bit hashes, made for whole Arrow batches at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[A-Za-z0-9_]+")
_HASHES: dict[str, int] = {}
_KEEP = 500_000
#: Odd multipliers of a 64-bit mixer.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > _KEEP:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = 3, least_words: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, ends, words)``: every text's distinct shingles, sorted, end to end; where each set ends; its words.

    Words are runs of ASCII letters, digits and ``_``, in lower case. Null texts and those of fewer
    than ``least_words`` words have an empty set.
    """
    counts, all_words = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        if t:
            w = _WORD.findall(t)
            counts[i] = len(w)
            if len(w) >= least_words:
                all_words += map(str.lower, w)
    kept = np.where(counts >= max(least_words, size), counts, 0)
    if least_words < size:
        kept = np.where(counts >= size, counts, 0)
    h = _word_hashes(all_words)
    doc = np.repeat(np.arange(len(texts)), np.where(counts >= least_words, counts, 0))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), counts
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for k in range(size):
            s = (s ^ h[k: k + n]) * np.uint64(_MULTIPLIERS[k % len(_MULTIPLIERS)])
            s = (s << np.uint64(23)) | (s >> np.uint64(41))
        s = mix(s)
    inside = doc[:n] == doc[size - 1:]
    s, d = s[inside], doc[:n][inside]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if len(s):
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
        s, d = s[first], d[first]
    ends = np.cumsum(np.bincount(d, minlength=len(texts)))
    return s, ends, counts
