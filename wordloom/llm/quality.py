"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Units are words and their shapes (letter case, digits and punctuation with runs cut
short, and whether a word repeats the one before), hashed to a fixed number of buckets.
Every unit has a sparse random index vector; its context vector is the sum of the index
vectors around it over the whole corpus. A document is the mean of the normalised context
vectors of its words and of its shapes, common units weighing less, with three counts. A
small network on these learns from labelled rows, and a temperature, fitted on rows that
the network has not seen, calibrates its probabilities.

Only the text is looked at; ids, labels, languages and sources are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import replacing

WORD_BUCKETS = 1 << 14
SHAPE_BUCKETS = 1 << 10
UNITS = WORD_BUCKETS + SHAPE_BUCKETS
DIMS = 64
ENTRIES = 2
SEED = 5
# Sums travel in blocks of units, first summed by groups of tasks and then over the groups.
BLOCKS = 64
TASK_GROUPS = 256
COMMON = 1e-3
# Labelled rows that the network is fitted on, at most; the rows with the least digests of their ids.
TRAINING_ROWS = 20_000
FOLDS = 5
HIDDEN = 32
EPOCHS = 40
STEP = 3e-3
DECAY = 1e-4
THRESHOLD = 0.3
FEATURES = 2 * DIMS + 3
# Tokens handled at once.
CHUNK = 100_000

SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))


class ShapeIds(dict):
    """Bucket of a shape, worked out once."""

    def __missing__(self, shape: bytes) -> int:
        self[shape] = WORD_BUCKETS + xxhash.xxh3_64_intdigest(shape) % (SHAPE_BUCKETS - 1)
        return self[shape]


REPEAT = WORD_BUCKETS + SHAPE_BUCKETS - 1


def units(text: str | None, shape_ids: ShapeIds) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a text and of their shapes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids = (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64)
    codes = np.frombuffer(raw.translate(SHAPES), np.uint8)
    if not len(words):
        return ids, ids
    short = codes[np.concatenate(([True], codes[1:] != codes[:-1]))].tobytes().split()
    shapes = np.fromiter((shape_ids[s] for s in short), np.int64, len(short))
    shapes[1:][hashed[1:] == hashed[:-1]] = REPEAT
    return ids, shapes


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every unit's index vector."""
    random = np.random.default_rng(SEED)
    return random.integers(0, DIMS, (UNITS, ENTRIES)), random.choice([-1.0, 1.0], (UNITS, ENTRIES))


def chunks(texts: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """Positions of texts with their units, some texts at a time."""
    shape_ids = ShapeIds()
    rows, words, shapes, size = [], [], [], 0
    for at, text in enumerate(texts):
        w, s = units(text, shape_ids)
        rows.append(at)
        words.append(w)
        shapes.append(s)
        size += len(w)
        if size >= CHUNK:
            yield rows, words, shapes
            rows, words, shapes, size = [], [], [], 0
    if rows:
        yield rows, words, shapes


def context_sums(docs: DataFrame) -> DataFrame:
    """``wl_block, wl_sums``: context vectors and counts of all units over all documents."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors()
        sums = np.zeros(UNITS * DIMS)
        counts = np.zeros(UNITS)
        for batch in batches:
            for _, words, shapes in chunks(batch["text"]):
                pairs = []
                for w, s in zip(words, shapes, strict=True):
                    pairs += [(w[1:], w[:-1]), (w[:-1], w[1:]), (w, s), (s[1:], s[:-1]), (s[:-1], s[1:])]
                of = np.concatenate([p[0] for p in pairs])
                near = np.concatenate([p[1] for p in pairs])
                for k in range(ENTRIES):
                    sums += np.bincount(of * DIMS + places[near, k], signs[near, k], UNITS * DIMS)
                counts += np.bincount(np.concatenate(words + shapes), minlength=UNITS)
        table = np.column_stack([sums.reshape(UNITS, DIMS), counts]).astype(np.float64)
        blocks = np.array_split(table, BLOCKS)
        group = xxhash.xxh3_64_intdigest(counts.tobytes()) % TASK_GROUPS
        yield pd.DataFrame([(k, group, b.astype(np.float32).tobytes()) for k, b in enumerate(blocks)], columns=["wl_block", "wl_group", "wl_sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["wl_sums"].iloc[0]) // 4)
        for part in group["wl_sums"]:
            total += np.frombuffer(part, np.float32)
        first = group.iloc[0]
        return pd.DataFrame([(first["wl_block"], first["wl_group"], total.astype(np.float32).tobytes())], columns=["wl_block", "wl_group", "wl_sums"])

    schema = "wl_block int, wl_group int, wl_sums binary"
    parts = docs.select("text").mapInPandas(collect, schema)
    by_tasks = parts.groupBy("wl_block", "wl_group").applyInPandas(add, schema)
    return by_tasks.groupBy("wl_block").applyInPandas(add, schema).select("wl_block", "wl_sums")


def unit_vectors(docs: DataFrame) -> np.ndarray:
    """Normalised, weighted context vectors of all units, a table of fixed size."""
    table = np.zeros((UNITS, DIMS + 1), np.float32)
    blocks = np.array_split(table, BLOCKS)
    for row in context_sums(docs).collect():
        blocks[row["wl_block"]][:] = np.frombuffer(row["wl_sums"], np.float32).reshape(-1, DIMS + 1)
    vectors, counts = table[:, :DIMS], table[:, DIMS]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, UNITS)):
        share = counts[part] / max(1.0, counts[part].sum())
        length[part] *= ((COMMON + share) / COMMON)[:, None] if part.start == 0 else 1.0
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: pd.Series, vectors: np.ndarray) -> np.ndarray:
    """Features of texts."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for rows, words, shapes in chunks(texts):
        sizes = np.array([len(w) for w in words])
        held = np.flatnonzero(sizes)
        at = np.array(rows)[held]
        if not len(held):
            continue
        starts = np.concatenate(([0], np.cumsum(sizes[held])[:-1]))
        count = sizes[held][:, None]
        out[at, :DIMS] = np.add.reduceat(vectors[np.concatenate(words)], starts) / count
        out[at, DIMS : 2 * DIMS] = np.add.reduceat(vectors[np.concatenate(shapes)], starts) / count
        repeats = np.concatenate(shapes) == REPEAT
        out[at, 2 * DIMS] = np.log1p(count[:, 0]) / 10
        out[at, 2 * DIMS + 1] = np.add.reduceat(repeats, starts) / count[:, 0]
        out[at, 2 * DIMS + 2] = [len(np.unique(words[k])) / sizes[k] for k in held]
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features, and the temperature of its probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray) -> Network:
    """Fit on seven rows of eight and the temperature on the rest; without both labels, a constant."""
    random = np.random.default_rng(SEED)
    width = features.shape[1] if len(features) else FEATURES
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    constant = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior, 1.0)
    if len(set(labels.tolist())) < 2:
        return constant
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = ((features - mean) / scale).astype(np.float64)
    held = np.arange(len(x)) % 8 == 7 if len(x) >= 80 else np.zeros(len(x), bool)
    train, y = np.flatnonzero(~held), labels.astype(np.float64)
    weights = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.array(prior)]
    moment, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = random.permutation(train)
        for at in np.array_split(order, max(1, len(order) // 256)):
            step += 1
            hidden = np.tanh(x[at] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - y[at]) / len(at)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [x[at].T @ back + DECAY * weights[0], back.sum(0), hidden.T @ error + DECAY * weights[2], error.sum()]
            for k, slope in enumerate(slopes):
                moment[k] = 0.9 * moment[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope**2
                weights[k] = weights[k] - STEP * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]), 1.0)
    if not held.any():
        return net
    logits, truth = net.logits(features[held]), y[held]
    loss = lambda t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean()
    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]), float(best))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo ``FOLDS``, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fitted_score(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Column:
    """The score of ``text`` as a column, learned from ``docs`` and ``labels``.

    Which rows teach is settled among the labels; they are few and are sent to all tasks,
    so no text is shuffled. What comes to the driver is the table of unit vectors, of
    fixed size, and the features of at most ``training_rows`` labelled rows.
    """
    vectors = unit_vectors(docs)

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in pooled(texts, vectors)], dtype=object)

    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("wl_quality"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = taught.select("doc_id", "wl_quality", features("text").alias("wl_features")).collect()
    sample.sort(key=lambda row: (row["doc_id"], bytes(row["wl_features"])))
    x = np.frombuffer(b"".join(bytes(row["wl_features"]) for row in sample), np.float32).reshape(-1, FEATURES)
    order = np.random.default_rng(SEED).permutation(len(x))
    net = fit(x[order], np.array([row["wl_quality"] for row in sample])[order])

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores(pooled(texts, vectors)))

    return scored("text")


def score_quality(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, the chance of label 1) and ``predicted``.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``quality``.
    Word vectors are gathered from all of ``docs``; the network learns from labelled rows
    that are not held out, at most ``training_rows`` of them. Null and empty texts have
    features of their own and get a score. Rows without a label or with a null one are
    scored and not learned from; a row that repeats is scored again. Without labels of
    both kinds every score is the share of label 1 among them, between 0 and 1. Columns
    of the names added are replaced; an empty table gives an empty one.
    """
    scored = docs.withColumn("wl_score", fitted_score(docs, labels, training_rows)).withColumn("wl_held", held_out())
    added = {"held_out": F.col("wl_held"), "score": F.col("wl_score"), "predicted": (F.col("wl_score") >= THRESHOLD).cast("int")}
    return replacing(scored, **added).drop("wl_score", "wl_held")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that the classifier does not reject."""
    scored = docs.withColumn("wl_score", fitted_score(docs, labels))
    return scored.where(F.col("wl_score") >= THRESHOLD).drop("wl_score")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document."""
    return score_quality(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
