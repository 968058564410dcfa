"""Products of a graph's matrix with vectors, several in one job.

A vector is cut like the nodes: one row for each range, with all vectors of the job so far
one after the other. Tiles are stored in buckets by the range that edges start from, so a
product moves vectors only, never edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from types import TracebackType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.blocks import WIDTH, BlockGraph, Tile, packed_tiles
from wordloom.session import drop_folder, table_path

# The newest vector from the last ones and its raw product: ``update(block, vectors, product)``.
Update = Callable[[int, np.ndarray, np.ndarray], np.ndarray]

# Ranges of nodes to a bucket, and the most buckets.
RANGES_A_BUCKET = 4
MOST_BUCKETS = 2048
VECTORS = "block int, vectors binary"


def vectors_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, WIDTH)


class Products:
    """The matrix of ``directed(a, b, weight)`` over a graph's nodes; a context that removes its table at the end."""

    def __init__(self, graph: BlockGraph, directed: DataFrame):
        self.graph, self._spark = graph, graph.numbered.sparkSession
        self.buckets = min(MOST_BUCKETS, -(-graph.side // RANGES_A_BUCKET))
        self._name, self._path = f"wordloom_{uuid.uuid4().hex}", table_path(self._spark)
        # Each range has a tile to itself, without weight if it has no edges inside.
        first = self._spark.range(graph.side).select((F.col("id") * WIDTH).cast("int").alias("a"))
        loops = first.select("a", F.col("a").alias("b"), F.lit(0.0).alias("weight"))
        tiles = packed_tiles(directed.unionByName(loops), shortest=False).withColumnRenamed("bi", "block")
        tiles = tiles.repartition(self.buckets, "block")
        tiles.write.option("path", self._path).bucketBy(self.buckets, "block").sortBy("block").saveAsTable(self._name)
        self.tiles = self._spark.table(self._name)

    def __enter__(self) -> Products:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        drop_folder(self._spark, self._path)

    def first(self, value: float) -> DataFrame:
        """The vector of ``value`` at every node: ``(block, vectors)``."""
        size = self.graph.size

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [np.where(block * WIDTH + np.arange(WIDTH) < size, value, 0.0).tobytes() for block in batch["id"]]
                yield pd.DataFrame({"block": batch["id"], "vectors": rows})

        return self._spark.range(self.graph.side).mapInPandas(fill, VECTORS)

    def following(self, vectors: DataFrame, steps: int, update: Update) -> DataFrame:
        """``vectors`` with ``steps`` more, each made by ``update`` from the matrix times the one before.

        A graph of one range has one tile, which makes all steps where it is.
        """

        def stay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    tile, found = Tile.of(row), vectors_of(row["vectors"])
                    for _ in range(steps):
                        product = np.bincount(tile.v, tile.w * found[-1][tile.u], WIDTH)
                        found = np.vstack([found, update(row["block"], found, product)])
                    yield pd.DataFrame({"block": [row["block"]], "vectors": [found.tobytes()]})

        if self.graph.side == 1:
            return vectors.join(self.tiles, "block").select("block", "u", "v", "w", "vectors").mapInPandas(stay, VECTORS)

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    tile, x = Tile.of(row), vectors_of(row["vectors"])[-1]
                    product = np.bincount(tile.v, tile.w * x[tile.u], WIDTH).astype(float)
                    found = [(row["bj"], product.tobytes(), None)]
                    if row["bj"] == row["block"]:
                        found.append((row["block"], None, row["vectors"]))
                    yield pd.DataFrame(found, columns=["block", "product", "vectors"], dtype=object)

        def append(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            # In order of their bytes, so that the sum does not depend on the order of arrival.
            product = sum(np.frombuffer(p) for p in sorted(rows["product"].dropna()))
            before = vectors_of(rows["vectors"].dropna().iloc[0])
            whole = np.vstack([before, update(key[0], before, product)])
            return pd.DataFrame({"block": [key[0]], "vectors": [whole.tobytes()]})

        for _ in range(steps):
            joined = vectors.join(self.tiles, "block").select("block", "bj", "u", "v", "w", "vectors")
            parts = joined.mapInPandas(multiply, "block int, product binary, vectors binary")
            vectors = parts.repartition(self.buckets, "block").groupBy("block").applyInPandas(append, VECTORS)
        return vectors


def scores_of(vectors: DataFrame, number: int) -> DataFrame:
    """One of the vectors as ``(node, score)``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data in zip(batch["block"], batch["vectors"], strict=True):
                yield pd.DataFrame({"node": block * WIDTH + np.arange(WIDTH), "score": vectors_of(data)[number]})

    return vectors.mapInPandas(rows, "node int, score double")


def changes(vectors: DataFrame) -> list[float]:
    """How far each vector is from the one before it: sums of absolute differences."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["vectors"]:
                change = np.abs(np.diff(vectors_of(data), axis=0)).sum(axis=1)
                yield pd.DataFrame({"step": np.arange(len(change)), "change": change})

    found = vectors.mapInPandas(sums, "step int, change double").groupBy("step").agg(F.sum("change").alias("change"))
    return [row["change"] for row in found.orderBy("step").collect()]


def triangle(vectors: DataFrame) -> np.ndarray:
    """The triangular factor of the vectors as columns.

    A task brings its ranges down to one factor; the factors of all tasks have one in common.
    """

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for data in batch["vectors"]:
                columns = vectors_of(data).T
                held = np.linalg.qr(columns if held is None else np.vstack([held, columns]), mode="r")
        if held is not None:
            yield pd.DataFrame({"factor": [held.tobytes()], "columns": [held.shape[1]]})

    rows = vectors.mapInPandas(factor, "factor binary, columns int").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(r["factor"]).reshape(-1, r["columns"]) for r in sorted(rows)]), mode="r")


def combined(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """The sum of the first vectors, each times its weight: ``(block, vectors)``."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vectors=[(weights @ vectors_of(data)[: len(weights)]).tobytes() for data in batch["vectors"]])

    return vectors.mapInPandas(add, VECTORS)
