"""Language identification by the nearest of several centroids per language.

A text is a unit vector: its letters in lower case, other characters as one space, give
grams of one to three code points, hashed to a fixed number of buckets and weighed by
logarithmic frequency and inverse document frequency. A language's documents are clustered by
cosine on a bounded sample of different texts; then every learning document is added to
the nearest of its language's clusters, and the sums are the centroids. A text goes to the
language of the centroid with the largest cosine. It is accepted if its distance to that
centroid is not unusual among the documents which made it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import replacing, struct

BUCKETS = 1 << 14
CLUSTERS = 4
# Different texts a language, about, on which its clusters are found.
CLUSTER_ROWS = 1000
CLUSTER_ROUNDS = 10
SEED = 12
FOLDS = 3
NO_LANGUAGE = "und"
# A distance so many standard deviations above the mean of a centroid's documents is unusual; the
# largest deviation of the language's centroids, as a centroid of copies has none.
DEVIATIONS = 4.0
# Vectors are added up as whole numbers, so that sums do not depend on their order.
FIXED = 1 << 28
# Sums are first added up by groups of tasks, then over the groups.
TASK_GROUPS = 64
# Code points of a text handled at once.
WINDOW = 1 << 18

OTHERS = regex.compile(r"\P{L}+")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SPACE = np.uint64(32)


def gram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the grams of up to three code points that end at the third code point or later."""
    mix = codes[2:] * MULTIPLIERS[0]
    found = [mix[codes[2:] != SPACE]]
    mix = mix ^ (codes[1:-1] * MULTIPLIERS[1])
    found.append(mix)
    found.append(mix ^ (codes[:-2] * MULTIPLIERS[2]))
    hashed = np.concatenate(found)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * MULTIPLIERS[1]
    return (hashed >> np.uint64(50)).astype(np.int64)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of a whole text's grams by bucket; none for a text without a letter."""
    total = np.zeros(BUCKETS, np.int64)
    before = np.array([SPACE, SPACE], np.uint64)
    letters = False
    text = text or ""
    for at in range(0, len(text), WINDOW):
        plain = OTHERS.sub(" ", text[at : at + WINDOW]).lower()
        if before[1] == SPACE:
            plain = plain.lstrip(" ")
        if not plain:
            continue
        letters = True
        codes = np.concatenate([before, np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)])
        total += np.bincount(gram_buckets(codes), minlength=BUCKETS)
        before = codes[-2:]
    if not letters:
        return None
    if before[1] != SPACE:
        total += np.bincount(gram_buckets(np.append(before, SPACE)), minlength=BUCKETS)
    return total


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's vector."""
    held = np.flatnonzero(counts)
    weights = (1 + np.log(counts[held])) * idf[held]
    return held, weights / np.sqrt((weights * weights).sum())


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo ``FOLDS``, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def inverse_frequencies(taught: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every bucket, over all texts of ``taught`` with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    held[:BUCKETS] += counts > 0
                    held[BUCKETS] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["bucket", "df"])

    rows = taught.select("text").mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    for row in rows:
        df[row["bucket"]] = row["df"]
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


def clustered(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids of unit vectors by cosine: distant starts, then rounds until nothing moves."""
    random = np.random.default_rng(SEED)
    centres = [vectors[random.integers(len(vectors))]]
    while len(centres) < min(clusters, len(vectors)):
        far = np.clip(1 - (vectors @ np.array(centres).T).max(axis=1), 0, None)
        if far.sum() < 1e-6:
            break
        centres.append(vectors[random.choice(len(vectors), p=far / far.sum())])
    table = np.array(centres)
    near = None
    for _ in range(CLUSTER_ROUNDS):
        now = (vectors @ table.T).argmax(axis=1)
        if near is not None and (now == near).all():
            break
        near = now
        for k in np.unique(near):
            total = vectors[near == k].sum(axis=0)
            table[k] = total / np.linalg.norm(total)
    return table


def seed_clusters(taught: DataFrame, idf: np.ndarray, clusters: int, rows: int) -> pd.DataFrame:
    """``lang, centre``: the clusters of each language's sample of different texts.

    A text is sampled by its digest, at a rate that gives a language about ``rows`` texts.
    """
    mark = F.xxhash64("text")
    # Collected and given back as constants: a join could shuffle all texts by language.
    counts = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).collect()
    if not counts:
        return pd.DataFrame({"lang": [], "centre": []}, dtype=object)
    size = F.try_element_at(F.create_map(*[F.lit(value) for row in counts for value in row]), F.col("lang"))
    marked = taught.where(F.pmod(mark, F.lit(1 << 32)) * size < rows * (1 << 32))
    sample = marked.select("lang", mark.alias("wl_mark"), "text").dropDuplicates(["lang", "wl_mark"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = group.sort_values("wl_mark")["text"].head(rows)
        counted = [c for c in map(gram_counts, texts) if c is not None]
        if not counted:
            return pd.DataFrame({"lang": [], "centre": []}, dtype=object)
        vectors = np.zeros((len(counted), BUCKETS), np.float32)
        for k, counts in enumerate(counted):
            held, weights = unit_vector(counts, idf)
            vectors[k, held] = weights
        return pd.DataFrame([(group["lang"].iloc[0], c.astype(np.float32).tobytes()) for c in clustered(vectors, clusters)], columns=["lang", "centre"])

    lang = taught.schema["lang"].dataType
    schema = T.StructType([T.StructField("lang", lang), T.StructField("centre", T.BinaryType())])
    return sample.groupBy("lang").applyInPandas(cluster, schema).toPandas().sort_values(["lang", "centre"], ignore_index=True)


@dataclass(frozen=True)
class Languages:
    """Centroids by bucket and number, their languages, and the least cosine that each accepts."""

    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    least: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether the text is accepted."""
        counts = gram_counts(text) if self.langs else None
        if counts is None:
            return NO_LANGUAGE, 0.0, False
        held, weights = unit_vector(counts, self.idf)
        cosines = weights @ self.centres[held]
        best = int(cosines.argmax())
        cosine = min(1.0, max(0.0, float(cosines[best])))
        return self.langs[best], cosine, cosine >= self.least[best]

    def column(self, text: str = "text") -> Column:
        """A struct ``lang, score, accepted`` for the column ``text``."""
        model = self

        @F.pandas_udf(struct(lang=T.StringType(), score=T.DoubleType(), accepted=T.BooleanType()))
        def identify(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([model.nearest(t) for t in texts], columns=["lang", "score", "accepted"])

        return identify(text)


def centroid_sums(taught: DataFrame, idf: np.ndarray, seeds: pd.DataFrame) -> pd.DataFrame:
    """``centre, sums``: for each seed the sum of the nearest vectors of its language, with their number, cosines and squares.

    Rows on the way are one for a task and centroid, added up by groups of tasks and then
    over the groups.
    """
    table = np.stack([np.frombuffer(c, np.float32) for c in seeds["centre"]]).astype(np.float64)
    of_lang = {lang: rows.index.to_numpy() for lang, rows in seeds.groupby("lang")}

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts = gram_counts(text.as_py()) if lang in of_lang else None
                if counts is None:
                    continue
                held, weights = unit_vector(counts, idf)
                cosines = table[np.ix_(of_lang[lang], held)] @ weights
                best = int(cosines.argmax())
                own = sums.setdefault(int(of_lang[lang][best]), np.zeros(BUCKETS + 3, np.int64))
                own[held] += np.round(weights * FIXED).astype(np.int64)
                cosine = float(cosines[best])
                own[BUCKETS:] += np.array([1, round(cosine * FIXED), round(cosine * cosine * FIXED)])
        group = sum(int(s[BUCKETS + 1]) for s in sums.values()) % TASK_GROUPS
        keys = sorted(sums)
        arrays = [pa.array(keys, pa.int32()), pa.array([group] * len(keys), pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["centre", "wl_group", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS + 3, np.int64)
        for part in rows["sums"]:
            total += np.frombuffer(part, np.int64)
        return pd.DataFrame([(*rows.iloc[0][["centre", "wl_group"]], total.tobytes())], columns=["centre", "wl_group", "sums"])

    schema = "centre int, wl_group int, sums binary"
    parts = taught.select("lang", "text").mapInArrow(collect, schema)
    by_tasks = parts.groupBy("centre", "wl_group").applyInPandas(add, schema)
    return by_tasks.groupBy("centre").applyInPandas(add, schema).toPandas().sort_values("centre", ignore_index=True)


def learn_languages(taught: DataFrame, clusters: int = CLUSTERS, cluster_rows: int = CLUSTER_ROWS) -> Languages:
    """Centroids of the languages of ``taught``, a table ``text, lang``.

    Rows without a language teach nothing, nor do texts without a letter. Frequencies and
    centroids come from all rows; ``cluster_rows`` bounds the sample of different texts a
    language on which its clusters are found. The model, of ``clusters`` times ``BUCKETS``
    numbers a language, passes through the driver to the tasks.
    """
    taught = taught.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    idf = inverse_frequencies(taught)
    seeds = seed_clusters(taught, idf, clusters, cluster_rows)
    if seeds.empty:
        return Languages(idf, np.zeros((BUCKETS, 0)), [], np.zeros(0))
    summed = centroid_sums(taught, idf, seeds)
    sums = np.stack([np.frombuffer(s, np.int64) for s in summed["sums"]]).astype(np.float64)
    centres = sums[:, :BUCKETS] / np.linalg.norm(sums[:, :BUCKETS], axis=1, keepdims=True)
    mean, square = sums[:, BUCKETS + 1] / FIXED / sums[:, BUCKETS], sums[:, BUCKETS + 2] / FIXED / sums[:, BUCKETS]
    langs = [seeds["lang"].iloc[k] for k in summed["centre"]]
    spread = pd.Series(np.sqrt(np.clip(square - mean * mean, 0, None))).groupby(langs).transform("max").to_numpy()
    least = mean - DEVIATIONS * spread - 1e-6
    return Languages(idf, np.ascontiguousarray(centres.T), langs, least)


def identify_languages(docs: DataFrame, clusters: int = CLUSTERS, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred``, ``score`` and ``accepted``.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``. Rows that ``held_out`` marks teach
    nothing; whether a row teaches and what is all that ids and languages decide.
    ``lang_pred`` is a language that was learned, ``und`` where the text is null or has no
    letter or nothing was learned. ``score`` is the cosine to the nearest centroid, 0 for
    ``und``; equal cosines go to the smaller language. ``accepted`` is false for ``und`` and for
    texts that are far from every centroid, such as other languages. Repeated rows teach
    and are answered each; a row without an id teaches. Columns of the names added are
    replaced; an empty table gives an empty one.
    """
    model = learn_languages(docs.where(~held_out()).select("text", "lang"), clusters, cluster_rows)
    found = docs.withColumn("wl_found", model.column()).withColumn("wl_held", held_out())
    added = {"held_out": F.col("wl_held"), "lang_pred": F.col("wl_found.lang"), "score": F.col("wl_found.score"), "accepted": F.col("wl_found.accepted")}
    return replacing(found, **added).drop("wl_found", "wl_held")


def language_digest(docs: DataFrame) -> DataFrame:
    """Predicted language of every document."""
    return identify_languages(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "accepted")
