"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered by how many words hold them, rarest first, and by place. The
first three are its prefix; two of them that do not overlap, of least total frequency, are
its pivots. One edit destroys at most one pivot. So of two words one edit apart, the one
whose prefix ends first in that order has a pivot that stands in the other's prefix, moved
by one place at most.

Position limits: what lies on the side of the pivot without the edit is equal, and on
the other side everything but one short hole around the edit. The index holds every prefix
gram of every word with each hole left out; a word asks for its pivots with the same
holes, one place shorter or longer. Words that share such a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import ascii_lower
from wordloom.session import checkpoint

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
# One occurrence in so many, chosen by a digest of document and word, loses a code point.
LOSS = 31
# Grams of a prefix: one edit touches two bigrams, so three hold two that do not overlap.
PREFIX = 3
# Places of a hole, more in words of over twelve times as many.
HOLE = 3
# A form has ten times the count of its word, so in 64 bits no chain is longer than 2 ** 5.
DOUBLINGS = 5

Hole = tuple[int, int]


def word_counts(docs: DataFrame, loss: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: runs of letters, A-Z in lower case, of at least ``min_length`` code points and ``min_count`` places.

    With ``loss``, an occurrence loses one code point where ``loss`` divides the crc32 of
    ``<doc_id>:<run>``; the digest modulo the run's length is its place. A null id counts
    as an empty one.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("wl_id"), F.explode(runs).alias("wl_run"))
    if loss is None:
        words = found.select(F.col("wl_run").alias("word"))
    else:
        mark = found.withColumn("wl_mark", F.crc32(F.concat("wl_id", F.lit(":"), "wl_run").cast("binary")))
        place = (F.col("wl_mark") % F.length("wl_run")).cast("int")
        shorter = F.concat(F.col("wl_run").substr(F.lit(1), place), F.col("wl_run").substr(place + 2, F.length("wl_run")))
        words = mark.select(F.when(F.col("wl_mark") % loss == 0, shorter).otherwise(F.col("wl_run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Places of the two grams that do not overlap and have the least total weight.

    ``grams`` are ``(place, weight)`` in order of places. For each gram as the second one,
    the lightest gram that ends before it is the first.
    """
    lightest: list[tuple[int, int]] = []
    best: tuple[int, int, int] | None = None
    for at, (place, weight) in enumerate(grams):
        before = [k for k in range(at) if grams[k][0] <= place - 2]
        if before:
            first_weight, first = lightest[before[-1]]
            if best is None or first_weight + weight < best[0]:
                best = (first_weight + weight, first, place)
        own = (weight, place)
        lightest.append(own if not lightest or own < lightest[-1] else lightest[-1])
    return [] if best is None else [best[1], best[2]]


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """Where the prefix ends in the order of grams, the places of its grams, and the places of the pivots.

    The prefix takes one gram more if it equals the last one and stands right behind it:
    an edit may have moved it there.
    """
    grams = sorted((order[word[i : i + 2]][0], i) for i in range(len(word) - 1))
    head = grams[:PREFIX]
    last, end = head[-1]
    more = [end + 1] if (last, end + 1) in grams[PREFIX : PREFIX + 1] else []
    chosen = pivots([(i, order[word[i : i + 2]][1]) for i in sorted(i for _, i in head)])
    return last << 32 | end, [i for _, i in head] + more, chosen


def holes(length: int, place: int) -> list[tuple[bool, Hole]]:
    """Holes right (true) and left of the gram at ``place``, in a word of ``length``, from the gram outwards.

    A hole is where the shared beginning ends and how long the shared end is.
    """
    step = max(HOLE, -(-length // 12))
    right = [(True, (h, max(0, length - h - step))) for h in range(place + 2, max(length, place + 3), step)]
    left = [(False, (max(0, e - step), length - e)) for e in range(place, min(0, place - 1), -step)]
    return right + left


def hole_key(word: str, hole: Hole) -> int:
    """Digest of a word without a hole, and of where the hole is."""
    start, rest = hole
    return xxhash.xxh3_64_intdigest(f"{word[:start]}\0{word[len(word) - rest :]}") - (1 << 63)


def index_keys(word: str, places: list[int]) -> set[int]:
    """Keys of a word's prefix grams."""
    return {hole_key(word, hole) for place in places for _, hole in holes(len(word), place)}


def query_keys(word: str, places: list[int]) -> set[int]:
    """Keys under which words one edit away hold one of a word's pivots.

    The other word may be one place shorter or longer; its holes are laid out as that word
    does: from a gram at the same distance from the unedited end.
    """
    found = set()
    for place in places:
        for change in (-1, 0, 1):
            length = len(word) + change
            for right, (start, rest) in holes(length, place):
                if right and start + rest <= min(length, len(word)):
                    found.add(hole_key(word, (start, rest)))
            for right, (start, rest) in holes(length, place + change) if place + change >= 0 else []:
                if not right and start + rest <= min(length, len(word)):
                    found.add(hole_key(word, (start, rest)))
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words that one edit tells apart, once.

    ``words`` has ``word`` (distinct, at least four code points) and ``n``. What is sent to
    the tasks is the order of the bigrams, at most the square of the letters.
    """
    grams = words.select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word")
    counts = grams.groupBy(F.substr("word", F.col("i"), F.lit(2)).alias("gram")).agg(F.count(F.lit(1)).alias("held"))
    ordered = sorted((row["held"], row["gram"]) for row in counts.collect())
    order = {gram: (rank, held) for rank, (held, gram) in enumerate(ordered)}

    def keyed(indexed: bool):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for first in range(0, len(batch), 2000):
                    part = batch.iloc[first : first + 2000]
                    found: list[tuple] = []
                    for word, n in zip(part["word"], part["n"], strict=True):
                        end, prefix, pivot = prefix_of(word, order)
                        keys = index_keys(word, prefix) if indexed else query_keys(word, pivot)
                        found += [(key, word, n, end) for key in keys]
                    yield pd.DataFrame(found, columns=["key", "word", "n", "ending"])

        return words.select("word", "n").mapInPandas(rows, "key long, word string, n long, ending long")

    asked = keyed(False).toDF("key", "a", "n_a", "end_a")
    index = keyed(True).toDF("key", "b", "n_b", "end_b")
    met = asked.join(index, "key").where((F.col("end_a") <= F.col("end_b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") != F.col("b")))
    close = met.where(F.levenshtein("a", "b", 1) == 1)
    one, other = F.struct(F.col("a").alias("w"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("w"), F.col("n_b").alias("n"))
    pair = close.select(F.least(one, other).alias("p"), F.greatest(one, other).alias("q")).distinct()
    return pair.select(F.col("p.w").alias("a"), F.col("p.n").alias("n_a"), F.col("q.w").alias("b"), F.col("q.n").alias("n_b"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word that has a form: the last of its chain of forms."""
    current = checkpoint(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("wl_further"))
        if current.join(further, "root", "left_semi").isEmpty():
            break
        current = checkpoint(current.join(further, "root", "left").select("word", F.coalesce("wl_further", "root").alias("root")))
    return current


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the distinct words of a table ``word, n``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form``
    is the one of them with the largest count (ties: the smallest word in code-point order),
    if that is at least ``ratio`` (2 or more) times the word's; else it and ``form_n`` are
    null. ``root`` follows forms to the last. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    kept = checkpoint(words.select("word", "n"))
    pairs = checkpoint(near_pairs(kept))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = ways.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.form").alias("wl_form"), (-F.col("best.less")).alias("wl_form_n"))
    enough: Column = F.col("wl_form_n") >= ratio * F.col("n")
    chosen = kept.join(best, "word", "left").select(
        "word",
        F.when(enough, F.col("wl_form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("wl_form_n")).alias("form_n"),
    )
    chosen = checkpoint(chosen)
    roots = follow(chosen.where("form is not null"))
    result = chosen.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return result.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_digest(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of whole ``documents``, some of which lose a letter.

    Null and empty texts have no words, repeated rows count again, other columns are not read.
    """
    return spelling_variants(word_counts(docs, LOSS))
