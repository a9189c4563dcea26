"""Words and word shingles of whole texts as numpy arrays, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(code of each word, row of each word, distinct words)`` of the texts, in order.

    Words are runs of anything but space and ``\\t`` to ``\\r``; ``lower`` lower-cases A-Z only.
    """
    lists = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, rows = pc.filter(words, full), pc.filter(rows, full)
    coded = words.combine_chunks().dictionary_encode() if isinstance(words, pa.ChunkedArray) else words.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if lower:  # the distinct words only; those that become equal share a code
        place: dict[str, int] = {}
        same = np.fromiter((place.setdefault(w.lower() if w.isascii() else w.translate(_LOWER), len(place)) for w in names), np.int64, len(names))
        codes, names = same[codes], list(place)
    return codes, rows.to_numpy(zero_copy_only=False).astype(np.int64), names


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every distinct ``size``-word shingle of each text, sorted by row and hash.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    codes, rows, words = word_codes(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(words)[codes]
    counts = np.bincount(rows, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out_rows, out = [], []
    if len(h) >= size:
        value = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            value = mix(value * _M + h[i:len(h) - size + 1 + i])
        whole = rows[:len(value)] == rows[size - 1:]
        out_rows.append(rows[:len(value)][whole])
        out.append(value[whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = counts[short].astype(np.uint64)
        for i in range(size - 1):
            has = counts[short] > i
            value[has] = mix(value[has] * _M + h[starts[short[has]] + i])
        out_rows.append(short)
        out.append(value)
    row, value = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]
