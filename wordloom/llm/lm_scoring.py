"""Packing of arrays and counts of words for language-model scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shingles import LOWER_ONLY, word_hashes
from wordloom.llm.suffix_dedup import unpacked

SMOOTHING = 0.5
# Tokens whose bigrams one task scores, about.
PART_TOKENS = 1_000_000
# A word with this share of all tokens or more is numbered; there are at most 1 / share.
HOT_SHARE = 2.0**-16
# Tokens of a run, about: a task keeps them before it sends its arrays on.
RUN_TOKENS = 2_000_000


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; a sorted one should come as differences."""
    packer = zstandard.ZstdCompressor(level=1)
    columns = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return packer.compress(b"".join(columns))


def unsqueezed(data: bytes, count: int, kinds: tuple) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(count))
        at += count * size
    return out


def lowered_words(data: bytes) -> list[bytes]:
    """Words of a packed text, A-Z in lower case."""
    return unpacked(data).translate(LOWER_ONLY).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``wl_word, wl_all, wl_good, wl_all_last, wl_good_last``: counts of word hashes in all documents, in the good ones, and as last words."""
    names = ["wl_all", "wl_good", "wl_all_last", "wl_good_last"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(hashes: list[np.ndarray], good: list[int]) -> pd.DataFrame:
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            sizes = np.array([len(h) for h in hashes])
            marked, ends = np.repeat(good, sizes), at[np.cumsum(sizes)[sizes > 0] - 1]
            counts = [np.bincount(at, minlength=len(words)), np.bincount(at, marked, len(words)), np.bincount(ends, minlength=len(words)), np.bincount(ends, np.array(good)[sizes > 0], len(words))]
            return pd.DataFrame({"wl_word": words.view(np.int64)} | {name: n.astype(np.int64) for name, n in zip(names, counts, strict=True)})

        hashes, good, size = [], [], 0
        for batch in batches:
            for data, mark in zip(batch["wl_text"], batch["wl_mark"], strict=True):
                h = word_hashes(lowered_words(data))
                hashes.append(h)
                good.append(mark)
                size += len(h)
            if size >= RUN_TOKENS:
                yield rows(hashes, good)
                hashes, good, size = [], [], 0
        if size:
            yield rows(hashes, good)

    parts = docs.select("wl_text", "wl_mark").mapInPandas(count, "wl_word long, " + ", ".join(f"{name} long" for name in names))
    return parts.groupBy("wl_word").agg(*[F.sum(name).alias(name) for name in names])
