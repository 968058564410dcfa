"""Near-duplicates by MinHash.

Texts with the same set of shingles form a class, so copies are handled once. Each class
has a one-permutation signature with optimal densification, cut into bands; classes that
agree on a band share a bucket. The candidates of a bucket form a star around its least
document, and candidates are confirmed on full sets. A star can miss links between its
outer members, so buckets whose members do not end up in one component are searched once
more: all members of different components are compared by sketches, in blocks, and those
that may be similar enough are confirmed on full sets too.

With 32 bands of 7 values, a pair at similarity 0.85 misses all bands with a chance of
4 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import struct
from wordloom.llm.components import components
from wordloom.llm.shingles import band_hashes, shingle_set, signature
from wordloom.session import checkpoint

PERCENT = 85
# Sets of fewer shingles than this have no partner but equal sets: 5 of 6 is below the limit.
LEAST_SHARED = 6
# A sketch holds the least hashes of a set: all of a set up to this size, a sample of a larger one.
SKETCH = 512
# Pairs of samples are passed over if they are this many standard errors below the limit.
SKETCH_ERRORS = 5
BLOCK = 256
# Hashes that are counted in one product.
COLUMNS = 4096


@F.pandas_udf(struct(n_shingles=T.LongType(), wl_class=T.BinaryType(), wl_bands=T.ArrayType(T.LongType())))
def summarised(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        shingles = shingle_set(text)
        bands = band_hashes(signature(shingles)).view(np.int64) if len(shingles) >= LEAST_SHARED else None
        rows.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), bands))
    return pd.DataFrame(rows, columns=["n_shingles", "wl_class", "wl_bands"])


@F.pandas_udf(struct(wl_same=T.BinaryType(), wl_sketch=T.BinaryType()))
def sketched(texts: pd.Series) -> pd.DataFrame:
    """The class that a text belongs to, and its sketch: the least hashes, cut to 32 bits."""
    rows = []
    for text in texts:
        shingles = shingle_set(text)
        rows.append((xxhash.xxh3_128_digest(shingles.tobytes()), (shingles[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=["wl_same", "wl_sketch"])


def alike_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the limit."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The rows of ``wl_a, wl_b`` whose full sets are similar enough; ``texts`` has ``wl_node, text``."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            kept = []
            for a, text_a, text_b in zip(batch["wl_a"], batch["wl_text_a"], batch["wl_text_b"], strict=True):
                if a not in last:
                    last = {a: shingle_set(text_a)}
                other = shingle_set(text_b)
                shared = len(np.intersect1d(last[a], other, assume_unique=True))
                kept.append(100 * shared >= percent * (len(last[a]) + len(other) - shared))
            yield batch.loc[kept, ["wl_a", "wl_b"]]

    b_side = texts.select(F.col("wl_node").alias("wl_b"), F.col("text").alias("wl_text_b"))
    a_side = texts.select(F.col("wl_node").alias("wl_a"), F.col("text").alias("wl_text_a"))
    both = pairs.select("wl_a", "wl_b").join(b_side, "wl_b").join(a_side, "wl_a")
    return both.mapInPandas(check, pairs.select("wl_a", "wl_b").schema)


def shared_counts(sketches: list[np.ndarray]) -> np.ndarray:
    """Number of hashes that each two sketches share, as products of 0/1 columns."""
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    _, column, uses = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    common = uses > 1
    number = np.where(common, np.cumsum(common) - 1, -1)[column]
    shared = np.zeros((len(sketches), len(sketches)), np.float32)
    for first in range(0, int(common.sum()), COLUMNS):
        here = (number >= first) & (number < first + COLUMNS)
        held = np.zeros((len(sketches), COLUMNS), np.float32)
        held[owner[here], number[here] - first] = 1
        shared += held @ held.T
    return shared


def likely(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sketches, one a sample at least, may belong to sets that are similar enough."""
    top = min(x[-1] if len(x) == SKETCH else np.uint32(0xFFFFFFFF) for x in (a, b))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    both = len(np.intersect1d(a, b))
    union, limit = len(a) + len(b) - both, percent / 100
    return both / union >= limit - SKETCH_ERRORS * np.sqrt(limit * (1 - limit) / union)


def open_members(members: DataFrame) -> DataFrame:
    """The rows of the buckets whose members are in several components, once for each pair of blocks that they are in.

    ``members`` has ``wl_bucket, wl_band, wl_node, component``. Buckets are cut into blocks
    of about ``BLOCK`` members; ``wl_i, wl_j`` is the pair, ``wl_mine`` the row's own block.
    """
    sizes = members.groupBy("wl_bucket").agg(F.count("*").alias("wl_size"), F.min("component").alias("wl_low"), F.max("component").alias("wl_high"))
    open_ = checkpoint(sizes.where("wl_low < wl_high").select("wl_bucket", F.ceil(F.col("wl_size") / BLOCK).cast("int").alias("wl_blocks")))
    mine = F.pmod(F.xxhash64("wl_node"), F.col("wl_blocks")).cast("int")
    rows = members.join(open_, "wl_bucket").withColumn("wl_mine", mine)
    rows = rows.withColumn("wl_other", F.explode(F.sequence(F.lit(0), F.col("wl_blocks") - 1)))
    rows = rows.withColumn("wl_i", F.least("wl_mine", "wl_other")).withColumn("wl_j", F.greatest("wl_mine", "wl_other"))
    return rows.drop("wl_other", "wl_blocks")


def possible_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components that their sketches do not rule out.

    ``members`` is as in ``open_members``, ``sketches`` has ``wl_node, n_shingles, wl_bands,
    wl_sketch``. Each pair of blocks is a group of its own. A pair comes from the first
    band on which it agrees. Sketches are joined to rows of open buckets only.
    """
    rows = checkpoint(open_members(members)).join(sketches, "wl_node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        nodes, label, size = group["wl_node"].to_numpy(), group["component"].to_numpy(), group["n_shingles"].to_numpy()
        sketches = [np.frombuffer(x, np.uint32) for x in group["wl_sketch"]]
        bands = np.stack([np.asarray(x, np.int64) for x in group["wl_bands"]])[:, : group["wl_band"].iloc[0]]
        mine, across = group["wl_mine"].to_numpy(), group["wl_i"].iloc[0] != group["wl_j"].iloc[0]
        shared = shared_counts(sketches)
        found = []
        for k in range(len(nodes) - 1):
            rest = slice(k + 1, None)
            low, high = np.minimum(size[rest], size[k]), np.maximum(size[rest], size[k])
            ok = (label[rest] != label[k]) & (low * 100 >= high * percent)
            if across:
                ok &= mine[rest] != mine[k]
            # Whole sets are judged by their counts, with one hash to spare for a collision.
            enough = 100 * (shared[k, rest] + 1) >= percent * (size[rest] + size[k] - shared[k, rest] - 1)
            at = np.flatnonzero(ok & (enough | (high > SKETCH))) + k + 1
            at = at[~(bands[at] == bands[k]).any(1)]
            found += [(min(nodes[k], nodes[x]), max(nodes[k], nodes[x])) for x in at if size[x] <= SKETCH >= size[k] or likely(sketches[k], sketches[x], percent)]
        return pd.DataFrame(found, columns=["wl_a", "wl_b"])

    kind = members.schema["wl_node"].dataType.simpleString()
    return rows.groupBy("wl_bucket", "wl_i", "wl_j").applyInPandas(compare, f"wl_a {kind}, wl_b {kind}").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Two documents are
    linked if they share ``percent`` of the union of their shingles or more;
    ``component_id`` is the least ``doc_id`` that links reach, ``kept`` says whether it is
    the document's own. Null or empty texts have no shingles and no links, shorter texts
    than a shingle are one. Rows that repeat a ``doc_id`` are one document: what one
    links, all link. A null ``doc_id`` takes no part: its component is null and it is not
    kept. An empty table gives an empty one.

    Only ids, digests and bands are shuffled for all documents; texts are joined for
    those that share a bucket with another text.
    """
    narrow = checkpoint(docs.select("doc_id", summarised("text").alias("wl_s")).select("doc_id", "wl_s.*"))
    named = narrow.where("doc_id is not null and n_shingles > 0")
    # Written before they are joined on their key: a join of two shuffles can split a hot
    # class or bucket, a join on top of an aggregate cannot.
    classes = checkpoint(named.groupBy("wl_class").agg(F.min("doc_id").alias("wl_node")))
    members = checkpoint(named.select("doc_id", "wl_class").join(classes, "wl_class").select("doc_id", "wl_class", "wl_node"))
    first = members.where("doc_id = wl_node").select("wl_class", "wl_node").distinct()
    banded = named.where("wl_bands is not null").join(first, (named["doc_id"] == first["wl_node"]) & (named["wl_class"] == first["wl_class"]))
    banded = checkpoint(banded.select(first["wl_class"], "wl_node", "n_shingles", "wl_bands").dropDuplicates(["wl_class"]))
    placed = banded.select("wl_node", F.posexplode("wl_bands").alias("wl_band", "wl_bucket"))
    buckets = placed.groupBy("wl_bucket").agg(F.min("wl_node").alias("wl_hub"), F.max("wl_node").alias("wl_last"))
    buckets = checkpoint(buckets.where("wl_hub < wl_last").select("wl_bucket", "wl_hub"))
    shared = checkpoint(placed.join(buckets, "wl_bucket").select("wl_bucket", "wl_band", "wl_node", "wl_hub"))
    nodes = checkpoint(shared.select("wl_node").distinct().join(banded, "wl_node"))
    texts = docs.select(F.col("doc_id").alias("wl_node"), "text").join(nodes, "wl_node")
    texts = texts.select("*", sketched("text").alias("wl_k")).where("wl_k.wl_same = wl_class")
    texts = texts.select("wl_node", "wl_class", "n_shingles", "wl_bands", "text", "wl_k.wl_sketch")
    texts = checkpoint(texts.dropDuplicates(["wl_class"]))

    sizes = nodes.select("wl_node", "n_shingles")
    star = shared.where("wl_node <> wl_hub").select(F.col("wl_hub").alias("wl_a"), F.col("wl_node").alias("wl_b")).distinct()
    star = star.join(sizes.toDF("wl_a", "wl_n_a"), "wl_a").join(sizes.toDF("wl_b", "wl_n_b"), "wl_b")
    star = checkpoint(star.where(alike_sizes("wl_n_a", "wl_n_b", percent)).select("wl_a", "wl_b").distinct())
    links = checkpoint(confirm(star, texts, percent))
    twice = members.groupBy("doc_id").agg(F.min("wl_node").alias("wl_a"), F.max("wl_node").alias("wl_z")).where("wl_a < wl_z")
    same = members.join(twice, "doc_id").select("wl_a", F.col("wl_node").alias("wl_b"))
    links = checkpoint(links.unionByName(same))
    labels = checkpoint(components(links, "wl_a", "wl_b"))

    joined = shared.drop("wl_hub").join(labels.withColumnRenamed("node", "wl_node"), "wl_node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "wl_node"))
    rest = checkpoint(possible_pairs(joined, texts.drop("text", "wl_class"), percent))
    more = checkpoint(confirm(rest, texts, percent))
    if more.first() is not None:
        labels = checkpoint(components(links.unionByName(more), "wl_a", "wl_b"))

    found = members.join(labels, members["wl_node"] == labels["node"], "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "wl_node")).alias("wl_component"))
    result = narrow.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("wl_component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of ``docs`` with one document for each group of near-duplicates.

    Of rows that repeat a ``doc_id`` one stays; rows without a ``doc_id`` stay.
    """
    kept = checkpoint(near_duplicates(docs, percent).where("kept").select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{name}`") for name in docs.columns])
