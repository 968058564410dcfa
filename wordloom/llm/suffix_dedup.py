"""Removal of repeated passages: every byte covered by a long string that starts twice.

The windows of all texts are tied to anchors (see ``suffixes``). A first pass counts the
grams at the anchors; only anchors whose gram occurs twice can hold repeats. Where all
anchors of a gram have the same surroundings, all their windows repeat. The other ones
are settled by a distributed merge sort of their suffixes: each task sorts the suffixes
it finds and sends them on as front-coded runs by gram; a task for each range of grams
merges the runs in a loser tree that never compares a known prefix again, and reads the
repeats off common prefixes and the bytes before the anchors.

Grams with more distinct surroundings than a task should hold are settled one window at a
time instead, by counting window digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import replacing, row_keys
from wordloom.llm.suffixes import WIDTH, anchors, by_gram, entry, merged, packed_run, removed, repeated_starts, unpacked_run
from wordloom.session import checkpoint

KEYS = ["wl_key", "wl_key2"]
ANCHOR = ["wl_gram", "wl_whole"]
# Distinct surroundings that one merging task holds, about; and those of one gram.
PART_ENTRIES = 40_000
GRAM_ENTRIES = 4_000
# Entries that a task keeps before it sends its runs.
RUN_ENTRIES = 100_000


def raw_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@F.pandas_udf(T.BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Compressed bytes of texts, smaller to shuffle; empty for null."""
    squeeze = zstandard.ZstdCompressor(level=1)
    return pd.Series([squeeze.compress(raw_text(text)) for text in texts])


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row an anchor: keys of the document, hash of the gram and of the surroundings, place, first and last window start."""
    schema = "wl_key long, wl_key2 long, wl_gram long, wl_whole long, wl_place long, wl_low long, wl_high long"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, keys, keys2, rows = [], [], [], []
            for key, key2, text in zip(batch["wl_key"], batch["wl_key2"], batch["text"], strict=True):
                found = anchors(raw_text(text))
                if len(found.place):
                    parts.append(found)
                    keys.append(key)
                    keys2.append(key2)
                    rows.append(len(found.place))
            if parts:
                place, low, high, gram, whole = (np.concatenate(column) for column in zip(*parts, strict=True))
                yield pd.DataFrame(
                    {
                        "wl_key": np.repeat(np.array(keys, np.int64), rows),
                        "wl_key2": np.repeat(np.array(keys2, np.int64), rows),
                        "wl_gram": gram.view(np.int64),
                        "wl_whole": whole.view(np.int64),
                        "wl_place": place,
                        "wl_low": low,
                        "wl_high": high,
                    }
                )

    long_enough = docs.where(F.octet_length("text") >= WIDTH)
    return long_enough.select(*row_keys(), "text").mapInPandas(find, schema)


def suffix_runs(found: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs ``wl_part, wl_run`` of the listed anchors; a run holds one task's entries of a part."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}
        size = 0

        def runs() -> pd.DataFrame:
            return pd.DataFrame([(part, packed_run(entries)) for part, entries in waiting.items()], columns=["wl_part", "wl_run"])

        for batch in batches:
            for key, key2, data, listed in zip(batch["wl_key"], batch["wl_key2"], batch["wl_text"], batch["wl_listed"], strict=True):
                raw = unpacked(data)
                for a in listed:
                    e = entry(raw, a["wl_place"], a["wl_low"], a["wl_high"], a["wl_gram"], a["wl_many"], (key, key2, a["wl_place"]))
                    waiting.setdefault(a["wl_gram"] % parts, []).append(e)
                    size += 1
            if size >= RUN_ENTRIES:
                yield runs()
                waiting, size = {}, 0
        if size:
            yield runs()

    return found.mapInPandas(make, "wl_part long, wl_run binary")


def merge_part(group: pd.DataFrame) -> pd.DataFrame:
    """Repeats of one part: keys of the document with first and last window start."""
    rows = []
    for same_gram in by_gram(merged([unpacked_run(run) for run in group["wl_run"]])):
        for e, low, high in repeated_starts(same_gram):
            key, key2, place = e.owner
            rows.append((key, key2, place - high, place - low))
    return pd.DataFrame(rows, columns=[*KEYS, "wl_low", "wl_high"])


def window_digests(found: DataFrame) -> DataFrame:
    """``wl_digest, wl_many`` and the place of every window of the listed anchors."""
    schema = "wl_digest binary, wl_many boolean, wl_key long, wl_key2 long, wl_low long"

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, key2, data, listed in zip(batch["wl_key"], batch["wl_key2"], batch["wl_text"], batch["wl_listed"], strict=True):
                raw = unpacked(data)
                rows = [
                    (hashlib.blake2b(raw[at : at + WIDTH], digest_size=16).digest(), a["wl_many"], key, key2, at)
                    for a in listed
                    for at in range(a["wl_low"], a["wl_high"] + 1)
                ]
                yield pd.DataFrame(rows, columns=["wl_digest", "wl_many", *KEYS, "wl_low"])

    return found.mapInPandas(digest, schema)


def repeated_windows(docs: DataFrame, part_entries: int = PART_ENTRIES, gram_entries: int = GRAM_ENTRIES) -> DataFrame:
    """Spans of window starts that repeat: ``wl_key, wl_key2, wl_low, wl_high``."""
    grams = anchor_rows(docs).groupBy("wl_gram").agg(F.count("*").alias("wl_count"), F.min("wl_whole").alias("wl_a"), F.max("wl_whole").alias("wl_z"))
    # Written before they are joined on their key, as are digests below: a join of two
    # shuffles can split a hot key, a join on top of an aggregate cannot.
    grams = checkpoint(grams.where("wl_count > 1").select("wl_gram", (F.col("wl_a") != F.col("wl_z")).alias("wl_mixed")))
    found = checkpoint(anchor_rows(docs).join(grams, "wl_gram"))
    span = [*KEYS, "wl_low", "wl_high"]
    settled = found.where("not wl_mixed").select(*span)

    open_ = found.where("wl_mixed")
    place = F.min(F.struct(*KEYS, "wl_place", "wl_low", "wl_high")).alias("wl_first")
    distinct = open_.groupBy(*ANCHOR).agg(F.count("*").alias("wl_count"), place)
    distinct = checkpoint(distinct.select(*ANCHOR, "wl_first.*", (F.col("wl_count") > 1).alias("wl_many")))
    copies = open_.select(*ANCHOR, *span).join(distinct.where("wl_many").select(*ANCHOR), ANCHOR).select(*span)

    busy = distinct.groupBy("wl_gram").agg(F.count("*").alias("wl_entries")).where(F.col("wl_entries") > gram_entries)
    busy = checkpoint(busy.select("wl_gram", F.lit(True).alias("wl_busy")))
    entries = distinct.join(busy, "wl_gram", "left").withColumn("wl_busy", F.coalesce("wl_busy", F.lit(False)))
    total = distinct.count()
    listed = entries.groupBy(*KEYS, "wl_busy").agg(F.collect_list(F.struct("wl_place", "wl_low", "wl_high", "wl_gram", "wl_many")).alias("wl_listed"))
    texts = docs.select(*row_keys(), "text").where(F.octet_length("text") >= WIDTH)
    with_text = texts.select(*KEYS, packed("text").alias("wl_text")).join(listed, KEYS)
    with_text = checkpoint(with_text.dropDuplicates([*KEYS, "wl_busy"]))

    runs = suffix_runs(with_text.where("not wl_busy"), max(1, math.ceil(total / part_entries)))
    merged_ = runs.groupBy("wl_part").applyInPandas(merge_part, "wl_key long, wl_key2 long, wl_low long, wl_high long")

    windows = window_digests(with_text.where("wl_busy"))
    held = windows.groupBy("wl_digest").agg(F.count("*").alias("wl_count"), F.max("wl_many").alias("wl_many"))
    held = checkpoint(held.where("wl_count > 1 or wl_many").select("wl_digest"))
    busy_spans = windows.join(held, "wl_digest").select(*KEYS, "wl_low", F.col("wl_low").alias("wl_high"))
    return settled.unionByName(copies).unionByName(merged_).unionByName(busy_spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, without ``text``, and what is left of it.

    Added: ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the
    bytes that are left, which may end inside a character. A byte is removed if a string
    of ``WIDTH`` bytes that covers it also starts anywhere else, in the same text or in
    another; overlaps count, and strings are judged on the input. Null and empty texts
    have no bytes. Equal rows are copies of each other. Columns of the names added are
    replaced; an empty table gives an empty one.
    """
    spans = repeated_windows(docs)
    per_doc = spans.groupBy(*KEYS).agg(F.collect_list(F.struct("wl_low", "wl_high")).alias("wl_spans"))
    keyed = docs.select("*", *row_keys()).withColumn("wl_text", packed("text")).drop("text")
    joined = keyed.join(per_doc, KEYS, "left").drop(*KEYS)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for data, listed in zip(texts, spans, strict=True):
            raw = unpacked(data)
            gone, runs, kept = removed(raw, [] if listed is None else [(s["wl_low"], s["wl_high"]) for s in listed])
            rows.append((len(raw), gone, runs, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    cut_ = joined.withColumn("wl_cut", cut("wl_text", "wl_spans")).drop("wl_text", "wl_spans")
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    return replacing(cut_, **{name: F.col(f"wl_cut.{name}") for name in names}).drop("wl_cut")


def suffix_digest(docs: DataFrame) -> DataFrame:
    """What is removed from every document, the rest as a digest."""
    cut = remove_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
