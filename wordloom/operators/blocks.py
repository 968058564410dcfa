"""An undirected graph in blocks: nodes numbered and cut into ranges, edges packed by pairs of ranges.

A tile holds the edges from one range of nodes to another as three arrays, so its size is
that of its edges. Tasks work on one pair of ranges at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import checkpoint, numbered

# Nodes of a range.
WIDTH = 1024


@dataclass(frozen=True)
class Tile:
    """Edges from places ``u`` of one range to places ``v`` of another, in order of ``u``."""

    u: np.ndarray
    v: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Tile:
        """From a row; without a tile in it, no edges."""
        if row["u"] is None:
            return cls(np.empty(0, np.int16), np.empty(0, np.int16), np.empty(0))
        return cls(np.frombuffer(row["u"], np.int16), np.frombuffer(row["v"], np.int16), np.frombuffer(row["w"]))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self.u, np.arange(WIDTH + 1))

    def onward(self, nodes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each of ``nodes`` that has edges: its number in the list, itself, the far ends and the weights."""
        for k, node in enumerate(nodes):
            first, last = self.starts[node], self.starts[node + 1]
            if first < last:
                yield k, int(node), self.v[first:last], self.w[first:last]

    def where(self, kept: np.ndarray) -> Tile:
        return Tile(self.u[kept], self.v[kept], self.w[kept])


class BlockGraph:
    """The graph ``edges(src, dst, weight)`` with its terms numbered in their order.

    Of repeated edges the least weight counts for distances, and the sum otherwise.
    """

    def __init__(self, edges: DataFrame):
        self._edges = edges

    @cached_property
    def numbered(self) -> DataFrame:
        """``(term, node)``, nodes in order of terms from 0."""
        terms = self._edges.select(F.explode(F.array("src", "dst")).alias("term")).distinct()
        return checkpoint(numbered(terms, "term", "node"))

    @cached_property
    def size(self) -> int:
        return self.numbered.count()

    @property
    def side(self) -> int:
        """Ranges of nodes."""
        return -(-self.size // WIDTH)

    def directed(self) -> DataFrame:
        """Every edge from either end, by numbers: ``(a, b, weight)``."""
        number = self.numbered
        ends = (
            self._edges.join(number.select(F.col("term").alias("src"), F.col("node").alias("a")), "src")
            .join(number.select(F.col("term").alias("dst"), F.col("node").alias("b")), "dst")
            .select("a", "b", F.col("weight").cast("double").alias("weight"))
        )
        return ends.unionByName(ends.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))

    def with_terms(self, scores: DataFrame) -> DataFrame:
        """``(node, score)`` as ``(term, score)``; terms without a score get 0."""
        return self.numbered.join(scores, "node", "left").select("term", F.coalesce("score", F.lit(0.0)).alias("score"))

    def no_scores(self) -> DataFrame:
        """The result for a graph without edges."""
        return self.numbered.select("term", F.lit(0.0).alias("score"))


def packed_tiles(directed: DataFrame, shortest: bool) -> DataFrame:
    """``(bi, bj, u, v, w)``: the edges ``(a, b, weight)`` from range to range; pairs of ranges without any are absent."""
    placed = directed.select(
        F.floor(F.col("a") / WIDTH).cast("int").alias("bi"),
        F.floor(F.col("b") / WIDTH).cast("int").alias("bj"),
        (F.col("a") % WIDTH).cast("int").alias("u"),
        (F.col("b") % WIDTH).cast("int").alias("v"),
        "weight",
    )

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place = (rows["u"].to_numpy(np.int64) * WIDTH) + rows["v"].to_numpy()
        weights = rows["weight"].to_numpy()
        if shortest:
            order = np.lexsort((weights, place))
            place, first = np.unique(place[order], return_index=True)
            weights = weights[order][first]
        else:
            place, of = np.unique(place, return_inverse=True)
            weights = np.bincount(of, weights)
        u, v = (place // WIDTH).astype(np.int16), (place % WIDTH).astype(np.int16)
        return pd.DataFrame([(*key, u.tobytes(), v.tobytes(), weights.astype(float).tobytes())], columns=["bi", "bj", "u", "v", "w"])

    return placed.groupBy("bi", "bj").applyInPandas(pack, "bi int, bj int, u binary, v binary, w binary")
