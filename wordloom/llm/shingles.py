"""Word shingles and one-permutation MinHash signatures of single texts."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

LOWER_ONLY = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = 5
BINS = 224
BANDS = 32
SEED = 7
PROBES = 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd factors, so that a sum of mixed hashes depends on their order.
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case. ``bytes.split`` splits at 09-0D and 20."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ONLY).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one if it is shorter, none if empty."""
    hashes = word_hashes(text_words(text))
    count = len(hashes)
    if not count:
        return hashes
    width = min(size, count)
    rolled = np.full(count - width + 1, width, np.uint64)
    for k in range(width):
        rolled += hashes[k : count - width + 1 + k] * FACTORS[k]
    rolled = np.sort(mixed(rolled))
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


@cache
def probes(bins: int) -> np.ndarray:
    """Bins that an empty bin looks at in turn, one column each, the same for every document."""
    return np.random.default_rng(SEED).integers(0, bins, (PROBES * PROBES, bins)).astype(np.int16)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of ``bins`` ranges; an empty bin takes the value of
    the first filled bin in a random sequence of its own (optimal densification)."""
    number = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
    values = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    at = number[first].astype(np.int64)
    values[at], filled[at] = shingles[first], True
    empty, table, row = np.flatnonzero(~filled), probes(bins), 0
    while len(empty) and row < len(table):
        looked = table[row : row + PROBES, empty]
        hit = filled[looked]
        some = hit.any(0)
        source = looked[hit.argmax(0), np.arange(len(empty))]
        values[empty[some]] = values[source[some]]
        empty, row = empty[~some], row + PROBES
    if len(empty):
        values[empty] = values[at[0]]
    return values


def band_hashes(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of the signature."""
    rows = values[: len(values) // bands * bands].reshape(bands, -1)
    width = rows.shape[1]
    return mixed(mixed(rows).dot(FACTORS[:width]) + np.arange(1, bands + 1, dtype=np.uint64) * MIX[0])
