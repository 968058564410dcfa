"""Cross-entropy difference of two interpolated bigram models over every word of a corpus.

The background model counts all documents, the target model those that labels call good.
Each is interpolated on its own: with ``c(v)`` words after ``v``,

    P(w | v) = (c(v, w) + BACKOFF * P(w)) / (c(v) + BACKOFF),

so the weight of the back-off, BACKOFF / (c(v) + BACKOFF), is that of the context in the
model; P(w) is smoothed over all words of the corpus. A document's first word has P(w).
A word's difference is its target loss less its background loss, and a document's score
is the mean over its words: the lower, the more like the target. Pairs that the target
has never seen count like the others.

No table of words is gathered. Words with a fixed share of all tokens or more, at most
1 / share, are numbered and broadcast; any other word is its 64-bit hash. Documents are
read in runs. A run's postings (word, word before) travel once: each distinct pair of the
run with its counts and the places of its documents, dealt by the hash of the word, those
of a numbered word by both. So a part holds all counts of its words and pairs, scores them
and sends each run back the sums of its documents, one packed row for a run and a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.lm_scoring import HOT_SHARE, PART_TOKENS, RUN_TOKENS, SMOOTHING, lowered_words, squeezed, unsqueezed, word_counts
from wordloom.llm.shingles import mixed, word_hashes
from wordloom.llm.suffix_dedup import packed
from wordloom.session import checkpoint

BACKOFF = 2.0
# Words by hash have this bit, numbered ones have not.
HASHED = np.uint64(1 << 63)
# What stands for the word before: no word; in a posting of its own, that the document ends with the word.
FIRST, LAST = (np.uint64((1 << 62) + k) for k in range(2))
COUNTED = (np.uint64, np.uint64, np.uint32, np.uint32)
# Rows of which the marked ones are listed together: their places in it are 16-bit numbers.
CHUNK_BITS = 12


class Numbered:
    """The common words with their counts in both models, as last words too."""

    def __init__(self, rows: list, kinds: int, tokens: int, good_tokens: int) -> None:
        rows = sorted(rows, key=lambda row: row["wl_word"] % (1 << 64))
        column = lambda name: np.array([row[name] for row in rows], np.int64)
        self.words = column("wl_word").view(np.uint64)
        self.all_size, self.good_size = tokens + SMOOTHING * kinds, good_tokens + SMOOTHING * kinds
        self.all, self.good = column("wl_all"), column("wl_good")
        self.all_last, self.good_last = column("wl_all_last"), column("wl_good_last")

    def shares(self, all_: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(w) of both models from the counts of words."""
        return (all_ + SMOOTHING) / self.all_size, (good + SMOOTHING) / self.good_size

    def codes(self, data: bytes) -> np.ndarray:
        """Words of a packed text: numbers of common ones, hashes of others."""
        hashes = word_hashes(lowered_words(data))
        if not len(self.words):
            return hashes | HASHED
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at.astype(np.uint64), hashes | HASHED)


def pair_difference(all_: np.ndarray, good: np.ndarray, all_share: np.ndarray, good_share: np.ndarray) -> np.ndarray:
    return np.log(all_ + BACKOFF * all_share) - np.log(good + BACKOFF * good_share)


def context_difference(all_: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.log(good + BACKOFF) - np.log(all_ + BACKOFF)


def part_of(words: np.ndarray, before: np.ndarray, parts: int) -> np.ndarray:
    dealt = np.where(words >= HASHED, mixed(words), mixed(words + mixed(before)))
    return (mixed(dealt) % np.uint64(parts)).astype(np.int64)


def pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(words + mixed(before))


def run_postings(codes: list[np.ndarray], marks: list[int]) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a run in order, their counts in all texts and in marked ones, and the texts' places, pair by pair.

    Words are numbered among themselves first, so that a pair is sorted as one number.
    """
    sizes = np.array([len(c) for c in codes])
    kinds, at = np.unique(np.concatenate(codes), return_inverse=True)
    place = np.repeat(np.arange(len(codes), dtype=np.uint32), sizes)
    ends = np.cumsum(sizes)[sizes > 0]
    before = np.roll(at, 1)
    before[ends - sizes[sizes > 0]] = len(kinds)
    at, place = np.append(at, at[ends - 1]), np.append(place, place[ends - 1])
    before = np.append(before, np.full(len(ends), len(kinds) + 1))
    key = (at.astype(np.uint64) << np.uint64(32)) | before.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    all_ = np.diff(new, append=len(key)).astype(np.uint32)
    good = np.add.reduceat(np.array(marks, np.uint32)[place], new, dtype=np.uint32)
    names = np.append(kinds, [FIRST, LAST])
    return names[(key[new] >> np.uint64(32)).astype(np.int64)], names[(key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)], all_, good, place


def in_parts(parts: int, words: np.ndarray, before: np.ndarray, all_: np.ndarray, good: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """A run's postings by part: part, number of pairs, packed pairs with counts, number of places, packed places."""
    part = part_of(words, before, parts).astype(np.min_scalar_type(parts))
    order, places = np.argsort(part, kind="stable"), place[np.argsort(np.repeat(part, all_), kind="stable")]
    edges = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    done = 0
    for low, high in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[low:high]
        w, size = words[own], int(all_[own].sum())
        pairs = squeezed(np.diff(w, prepend=np.zeros(1, w.dtype)), before[own], all_[own], good[own])
        yield int(part[own[0]]), len(own), pairs, size, squeezed(places[done : done + size])
        done += size


def worths(words: Numbered, w: np.ndarray, v: np.ndarray, all_: np.ndarray, good: np.ndarray) -> np.ndarray:
    """What each posting of the listed pairs adds to the sum of its document; a pair may be listed for many runs.

    A word counts as a context wherever it stands, and is taken back where a document ends with it.
    """
    _, pair = np.unique(pair_keys(w, v), return_inverse=True)
    pair_all, pair_good = (np.bincount(pair, x)[pair] for x in (all_, good))
    kinds, at = np.unique(w, return_inverse=True)
    last = v == LAST
    totals = [np.bincount(at, np.where(which, x, 0)) for which in (~last, last) for x in (all_, good)]
    common = kinds < HASHED
    number = kinds[common].astype(np.int64)
    for total, known in zip(totals, (words.all, words.good, words.all_last, words.good_last), strict=True):
        total[common] = known[number]
    total_all, total_good, last_all, last_good = totals
    all_share, good_share = words.shares(total_all, total_good)
    single = np.log(all_share) - np.log(good_share)
    context = context_difference(total_all - last_all, total_good - last_good)
    worth = np.where(v == FIRST, single[at], pair_difference(pair_all, pair_good, all_share[at], good_share[at]))
    return np.where(last, 0, worth) + np.where(last, -context[at], context[at])


def score_documents(docs: DataFrame, good: DataFrame, part_tokens: int = PART_TOKENS, hot_share: float = HOT_SHARE) -> DataFrame:
    """``doc_id, n_tokens, difference``, one row for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; ``good`` has the ``doc_id`` of the target's
    documents (repeats and nulls do not count). ``difference`` is in nats, null for texts
    without words. Equal rows get equal scores. Without a target document its words are
    alike. ``hot_share`` and ``part_tokens`` move work, not scores. Other columns are not
    read; an empty table gives an empty one.
    """
    return scored(marked_texts(docs, good), part_tokens, hot_share)


def marked_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """``doc_id, wl_text, wl_row, wl_mark``: packed texts, written once; the mark is 1 for the target's documents.

    Texts are not shuffled to be marked: ids are, and each chunk of rows gets the places of its
    marked ones, two bytes each, a table that Spark broadcasts as long as it is small.
    """
    target = good.where("doc_id is not null").select("doc_id").distinct()
    texts = checkpoint(docs.select("doc_id", packed("text").alias("wl_text"), F.monotonically_increasing_id().alias("wl_row")))
    chunk, place = F.shiftright("wl_row", CHUNK_BITS), F.col("wl_row").bitwiseAND((1 << CHUNK_BITS) - 1).cast("short")
    found = texts.select("doc_id", "wl_row").join(target, "doc_id", "left_semi")
    places = checkpoint(found.groupBy(chunk.alias("wl_chunk")).agg(F.collect_list(place).alias("wl_places")))
    joined = texts.withColumn("wl_chunk", chunk).join(places, "wl_chunk", "left")
    mark = F.coalesce(F.array_contains("wl_places", place), F.lit(False)).cast("long")
    return joined.select("doc_id", "wl_text", "wl_row", mark.alias("wl_mark"))


def scored(marked: DataFrame, part_tokens: int, hot_share: float) -> DataFrame:
    """Scores of ``doc_id, wl_text, wl_mark, wl_row``, where the mark is 1 for the target's documents."""
    counts = checkpoint(word_counts(marked))
    kinds, tokens, good_tokens = (x or 0 for x in counts.agg(F.count("*"), F.sum("wl_all"), F.sum("wl_good")).first())
    limit = max(1.0, tokens * hot_share)
    words = Numbered(counts.where(F.col("wl_all") >= limit).collect(), kinds, tokens, good_tokens)
    parts = max(1, math.ceil(tokens / part_tokens))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packed postings of runs for every part; rows and sizes of a run's documents go with them."""

        def rows() -> pd.DataFrame:
            run, sizes = row[0], np.array([len(c) for c in codes], np.int64)
            found = [(int(run % parts), run, len(row), None, 0, squeezed(np.array(row, np.int64), sizes))]
            if sizes.any():
                found += [(part, run, *x) for part, *x in in_parts(parts, *run_postings(codes, marks))]
            return pd.DataFrame(found, columns=["wl_part", "wl_run", "wl_count", "wl_pairs", "wl_size", "wl_places"])

        row, codes, marks, size = [], [], [], 0
        for batch in batches:
            for number, data, mark in zip(batch["wl_row"], batch["wl_text"], batch["wl_mark"], strict=True):
                row.append(number)
                codes.append(words.codes(data))
                marks.append(mark)
                size += len(codes[-1])
                if size >= RUN_TOKENS:
                    yield rows()
                    row, codes, marks, size = [], [], [], 0
        if row:
            yield rows()

    def gain(posts: pd.DataFrame) -> pd.DataFrame:
        """Sums of a part for the documents of each run, by their places."""
        heads, posts = posts[posts["wl_pairs"].isna()], posts[posts["wl_pairs"].notna()]
        found = [(run, -1, n, blob) for run, n, blob in zip(heads["wl_run"], heads["wl_count"], heads["wl_places"], strict=True)]
        blocks = [unsqueezed(blob, int(n), COUNTED) for n, blob in zip(posts["wl_count"], posts["wl_pairs"], strict=True)]
        if blocks:
            w, v, all_, good = (np.concatenate(x) for x in zip(*[(np.cumsum(w, dtype=np.uint64), *x) for w, *x in blocks], strict=True))
            worth, done = worths(words, w, v, all_, good), 0
            for run, n, size, blob in zip(posts["wl_run"], posts["wl_count"], posts["wl_size"], posts["wl_places"], strict=True):
                (place,) = unsqueezed(blob, int(size), (np.uint32,))
                sums = np.bincount(place, np.repeat(worth[done : done + n], all_[done : done + n]))
                held = np.flatnonzero(np.bincount(place))
                found.append((run, int(posts["wl_part"].iloc[0]), len(held), squeezed(np.diff(held, prepend=0).astype(np.uint32), sums[held])))
                done += n
        return pd.DataFrame(found, columns=["wl_run", "wl_part", "wl_count", "wl_sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        """Sums of a run's documents over all parts, in the order of the parts."""
        group = group.sort_values("wl_part")
        head, *others = zip(group["wl_count"], group["wl_sums"], strict=True)
        row, size = unsqueezed(head[1], int(head[0]), (np.int64, np.int64))
        total = np.zeros(len(row))
        for n, blob in others:
            held, sums = unsqueezed(blob, int(n), (np.uint32, np.float64))
            total[np.cumsum(held)] += sums
        return pd.DataFrame({"wl_row": row, "n_tokens": size, "wl_gain": total})

    schema = "wl_part long, wl_run long, wl_count long, wl_pairs binary, wl_size long, wl_places binary"
    posted = marked.select("wl_row", "wl_text", "wl_mark").mapInPandas(post, schema)
    gains = posted.groupBy("wl_part").applyInPandas(gain, "wl_run long, wl_part long, wl_count long, wl_sums binary")
    per_row = gains.groupBy("wl_run").applyInPandas(add, "wl_row long, n_tokens long, wl_gain double")
    joined = marked.select("wl_row", "doc_id").join(per_row, "wl_row", "left")
    mean = F.when(F.col("n_tokens") > 0, F.col("wl_gain") / F.col("n_tokens"))
    return joined.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), mean.alias("difference"))


def lm_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cross-entropy difference of every document to the documents of quality 1, rounded to nine places."""
    good = labels.where("quality = 1").select("doc_id")
    result = score_documents(docs.select("doc_id", "text"), good)
    return result.select("doc_id", "n_tokens", F.round("difference", 9).alias("difference"))
