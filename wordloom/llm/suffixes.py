"""Kernels of the suffix search: anchors of one text, front-coded runs, loser-tree merging.

An anchor is the place of the least hashed gram among the grams of a window; equal windows
have their anchor at the same distance from their start. So windows of one anchor need
only be compared with windows of anchors that have the same gram.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import zstandard

from wordloom.llm.shingles import mixed

WIDTH = 200
GRAM = 32
GRAMS = WIDTH - GRAM + 1
BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)
# Groups up to this size are compared pair by pair.
PAIRWISE = 12


@cache
def powers_to(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for 2**bits places."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


class Anchors(NamedTuple):
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def anchors(raw: bytes) -> Anchors:
    """Anchors of a text: place, first and last start of their windows, hash of the gram, hash of all their windows' bytes."""
    size = len(raw)
    if size < WIDTH:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.view(np.uint64), none.view(np.uint64))
    power, inverse = powers_to(max(12, size.bit_length()))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE_VALUES[np.frombuffer(raw, np.uint8)] * power[:size], out=sums[1:])
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: size - GRAM + 1])
    least = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= GRAMS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < GRAMS:
        least = np.minimum(least[: span - GRAMS], least[GRAMS - span :])
    at = (least & LOW).astype(np.int64)
    low = np.flatnonzero(np.diff(at, prepend=-1))
    high = np.append(low[1:], len(at)) - 1
    place = at[low]
    whole = (sums[high + WIDTH] - sums[low]) * inverse[low]
    shape = ((place - low) << 16 | (high - low)).astype(np.uint64)
    return Anchors(place, low, high, gram[place], mixed(mixed(whole) + shape * np.uint64(BASE)))


class Entry(NamedTuple):
    """A distinct anchor: its suffix, what stands before it (nearest byte first), the least distance
    of a window start before it, whether the same bytes occur twice, and where it is."""

    suffix: bytes
    before: bytes
    least: int
    many: bool
    gram: int
    owner: tuple


def entry(raw: bytes, place: int, low: int, high: int, gram: int, many: bool, owner: tuple) -> Entry:
    return Entry(raw[place : high + WIDTH], raw[low:place][::-1], place - high, many, gram, owner)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at again."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[known:size], "big") ^ int.from_bytes(b[known:size], "big")
    return size - (differ.bit_length() + 7) // 8


def packed_run(entries: Iterable[Entry]) -> bytes:
    """A sorted run, front-coded: each suffix as the length it shares with the one before and the rest."""
    coded, last = [], b""
    for e in sorted(entries):
        shared = common(last, e.suffix)
        coded.append((shared, e.suffix[shared:], *e[1:]))
        last = e.suffix
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(coded, protocol=5))


def unpacked_run(run: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries of a run with the length of prefix each shares with the one before."""
    last = b""
    for shared, rest, *fields in pickle.loads(zstandard.ZstdDecompressor().decompress(run)):
        last = last[:shared] + rest
        yield shared, Entry(last, *fields)


def merged(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """All entries in order of suffix, each with the prefix it shares with the one before.

    A loser tree. Every waiting entry knows the prefix it shares with the entry that beat
    it; two entries that know different lengths are ordered by those alone, and otherwise
    compared from the known length on, so no known prefix is compared again.
    """
    count = len(runs)
    heads: list[Entry | None] = [None] * count
    known = [0] * count
    losers = [-1] * count

    def advance(run: int) -> None:
        known[run], heads[run] = next(runs[run], (-1, None))

    def winner(a: int, b: int) -> tuple[int, int]:
        """The run whose head comes first, and the other."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a].suffix, heads[b].suffix
        shared = common(x, y, known[a])
        first = x[shared : shared + 1] <= y[shared : shared + 1]
        a, b = (a, b) if first else (b, a)
        known[b] = shared
        return a, b

    for run in range(count):
        advance(run)
        known[run] = 0
    best = -1
    for run in range(count):  # play up until an empty place takes the loser
        node, carried = (run + count) // 2, run
        while node > 0:
            if losers[node] < 0:
                losers[node], carried = carried, -1
                break
            carried, losers[node] = winner(carried, losers[node])
            node //= 2
        if carried >= 0:
            best = carried
    while best >= 0 and heads[best] is not None:
        yield known[best], heads[best]
        advance(best)
        node, carried = (best + count) // 2, best
        while node > 0:
            carried, losers[node] = winner(carried, losers[node])
            node //= 2
        best = carried


def distances(one: Entry, other: Entry, right: int) -> tuple[int, int]:
    """Least and greatest distance before the anchor at which windows of the two are equal; ``right`` is their common suffix part."""
    return max(WIDTH - right, one.least, other.least), common(one.before, other.before)


def repeated_starts(group: list[tuple[int, Entry]]) -> Iterator[tuple[Entry, int, int]]:
    """For the entries of one gram, in order of suffix: spans of distances whose windows another entry holds too.

    Entries that occur twice are known to repeat and are only compared with.
    """
    entries = [e for _, e in group]
    if len(entries) <= PAIRWISE:
        for i, one in enumerate(entries):
            right = len(one.suffix)
            for k in range(i + 1, len(entries)):
                right = min(right, group[k][0])
                low, high = distances(one, entries[k], right)
                if low <= high:
                    for e in (one, entries[k]):
                        if not e.many:
                            yield e, low, high
        return
    shared = np.array([length for length, _ in group])
    most = np.array([len(e.before) for e in entries])
    least = np.array([e.least for e in entries])
    before = np.zeros((len(entries), most.max() + 1), np.uint8)
    for i, e in enumerate(entries):
        before[i, : most[i]] = np.frombuffer(e.before, np.uint8)
    left = np.zeros(len(entries), np.uint64)
    twice = np.zeros((most.max() + 1, len(entries)), bool)
    for distance in range(most.max() + 1):
        if distance:
            left = left * np.uint64(BASE) + BYTE_VALUES[before[:, distance - 1]]
        valid = np.flatnonzero((least <= distance) & (distance <= most))
        if len(valid) > 1:
            same_right = np.cumsum(shared < WIDTH - distance)
            key = mixed(left + mixed(same_right.astype(np.uint64)))[valid]
            _, group_of, sizes = np.unique(key, return_inverse=True, return_counts=True)
            twice[distance, valid] = sizes[group_of] > 1
    for i, e in enumerate(entries):
        if not e.many and twice[:, i].any():
            edges = np.flatnonzero(np.diff(twice[:, i].astype(np.int8), prepend=0, append=0))
            yield from ((e, int(low), int(high) - 1) for low, high in edges.reshape(-1, 2))


def by_gram(entries: Iterable[tuple[int, Entry]]) -> Iterator[list[tuple[int, Entry]]]:
    """Runs of entries with the same gram."""
    group: list[tuple[int, Entry]] = []
    for item in entries:
        if group and group[-1][1].gram != item[1].gram:
            yield group
            group = []
        group.append(item)
    if group:
        yield group


def removed(raw: bytes, starts: Iterable[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes covered by windows that start in any of the spans, number of maximal runs, and what is left."""
    marks = np.zeros(len(raw) + 1, np.int32)
    for low, high in starts:
        marks[low] += 1
        marks[high + WIDTH] -= 1
    gone = np.cumsum(marks[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw) - len(kept), runs, kept
