"""An index for searching the same table again and again.

A row is listed under every distinct gram, that is run of a few characters, of its texts. A
word can only stand in rows that are listed under all of the word's grams, so a search
reads the lists of its rarest grams, keeps the rows that are in all of them, and looks at
those rows alone. Lists are stored in order of their grams, so that a search skips the
rest of the files; a list may stretch over several files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import checkpoint

GRAM = 2
# Lists that a search reads: the shortest ones of its grams.
LISTS = 4
# Rows of lists that one task sorts, and so one file holds, about.
LIST_ROWS = 1 << 20


@dataclass(frozen=True)
class SearchIndex:
    """``lists``: ``(gram, <key>)`` in order of grams; ``sizes``: ``(gram, n)``."""

    key: str
    columns: tuple[str, ...]
    gram: int
    lists: DataFrame
    sizes: DataFrame


def build_index(table: DataFrame, key: str, columns: Sequence[str], gram: int = GRAM) -> SearchIndex:
    """Index of whole texts; ``key`` tells the rows apart. Nulls are as empty texts.

    Rows of lists are written before they are sorted: their number says into how many ranges.
    Spark would choose ranges by their bytes in the shuffle, which rows of few grams
    and similar keys shrink many times over, and one task would sort tens of millions.
    """
    if gram < 1:
        raise ValueError("a gram has at least one character")
    pattern = F.lit(f"(?s)(?=({'.' * gram}))")
    found = [F.coalesce(F.regexp_extract_all(F.col(name), pattern, F.lit(1)), F.array().cast("array<string>")) for name in columns]
    grams = table.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("gram"))
    grams = checkpoint(grams.select("gram", key))
    ranges = max(1, math.ceil(grams.count() / LIST_ROWS))
    lists = checkpoint(grams.repartitionByRange(ranges, "gram", key).sortWithinPartitions("gram", key))
    sizes = checkpoint(lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    return SearchIndex(key, tuple(columns), gram, lists, sizes)


def word_grams(word: str, gram: int) -> list[str]:
    return sorted({word[i : i + gram] for i in range(len(word) - gram + 1)})


def candidates(index: SearchIndex, word: str) -> DataFrame | None:
    """Keys of the rows that may hold ``word``; none for a word shorter than a gram, as any row may."""
    grams = word_grams(word, index.gram)
    if not grams:
        return None
    sizes = {row["gram"]: row["n"] for row in index.sizes.where(F.col("gram").isin(grams)).collect()}
    read = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:LISTS]
    listed = index.lists.where(F.col("gram").isin(read)).groupBy(index.key).agg(F.count(F.lit(1)).alias("n"))
    return listed.where(F.col("n") == len(read)).select(index.key)


def rows_with(table: DataFrame, index: SearchIndex, word: str) -> DataFrame:
    """Rows of the indexed ``table`` that hold ``word`` in one of the indexed columns."""
    few = candidates(index, word)
    hit = F.lit(False)
    for name in index.columns:
        hit = hit | F.coalesce(F.contains(F.col(name), F.lit(word)), F.lit(False))
    return (table if few is None else table.join(few, index.key, "left_semi")).where(hit)
