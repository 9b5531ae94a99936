"""Word shingles of whole texts as 64-bit hashes, computed over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.common import mix, texts

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (blanks split, A-Z count as a-z) and the first word of each document, with the end."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word ends with its document
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    begins = np.flatnonzero(start)
    place = np.cumsum(inside) - 1  # among the bytes of words
    at = place[begins]
    letters = LOWER[data[inside]].astype(np.uint64)
    if not len(begins):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    length = np.diff(np.append(at, len(letters)))
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = BASE
    power = np.cumprod(power, dtype=np.uint64)
    letters += np.uint64(1)
    letters *= power[np.arange(len(letters)) - np.repeat(at, length)]
    return mix(np.add.reduceat(letters, at) ^ (length.astype(np.uint64) << np.uint64(40))), np.searchsorted(begins, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; entry i starts at word i, of the whole array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= BASE
        total += words[j : j + n]
    return mix(total + np.uint64(k))


def document_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words."""
    data, offsets, _ = texts(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        words, firsts = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        shingles = shingle_hashes(words, k)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            else:
                yield shingle_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)
        at = to


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set of hashes."""
    total = np.add.reduce(mix(hashes ^ BASE), dtype=np.uint64) ^ np.uint64(len(hashes) << 32)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
