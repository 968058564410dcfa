"""The five centralities of an undirected weighted graph ``edges(src, dst, weight)``.

Each returns ``(term, score)`` for every term that has an edge. Iterations keep one
written table at a time and read the edges in the buckets they were stored in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.constants import PAGERANK_ALPHA, PAGERANK_ROUNDS, PAGERANK_TOLERANCE
from wordloom.operators import paths, products
from wordloom.operators.blocks import WIDTH, BlockGraph
from wordloom.session import Rounds, checkpoint


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: ``(src, dst, weight)``."""
    return edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Sum of the weights of a term's edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("term"), "weight")
    return ends.groupBy("term").agg(F.sum("weight").cast("double").alias("score"))


def closeness(edges: DataFrame) -> DataFrame:
    """Closeness over distances ``1 / weight``, scaled by the reachable part of the graph."""
    graph = BlockGraph(edges.select("src", "dst", (F.lit(1.0) / F.col("weight")).alias("weight")))
    if graph.size == 0:
        return graph.no_scores()
    others = F.lit(graph.size - 1.0)
    score = F.coalesce(F.try_divide("reached", "total") * F.try_divide("reached", others), F.lit(0.0))
    return graph.with_terms(paths.reach(graph).select("node", score.alias("score")))


def betweenness(edges: DataFrame) -> DataFrame:
    """Share of shortest paths through a term, the weight itself being the distance."""
    graph = BlockGraph(edges)
    if graph.size == 0:
        return graph.no_scores()
    through = paths.dependencies(graph)
    pairs = (graph.size - 1) * (graph.size - 2)
    score = F.col("through") / F.lit(float(pairs)) if pairs > 0 else F.lit(0.0)
    return graph.with_terms(through.select("node", score.alias("score")))


# Rounds of PageRank between two written tables.
PAGERANK_STRIDE = 5


def pagerank(
    edges: DataFrame,
    alpha: float = PAGERANK_ALPHA,
    max_rounds: int = PAGERANK_ROUNDS,
    tolerance: float = PAGERANK_TOLERANCE,
) -> DataFrame:
    """Weighted PageRank; stops once the ranks move less than ``tolerance`` per node.

    Several rounds are one job and one table, of which the first that moves little enough
    is taken.
    """
    graph = BlockGraph(edges)
    size = graph.size
    if size == 0:
        return graph.no_scores()
    directed = checkpoint(graph.directed())
    degrees = directed.groupBy("a").agg(F.sum("weight").alias("degree"))
    moves = directed.join(degrees, "a").select("a", "b", (F.col("weight") / F.col("degree")).alias("weight"))

    def update(block: int, before: np.ndarray, product: np.ndarray) -> np.ndarray:
        real = block * WIDTH + np.arange(WIDTH) < size
        return np.where(real, alpha * product + (1.0 - alpha) / size, 0.0)

    with products.Products(graph, moves) as matrix, Rounds() as kept:
        ranks = matrix.first(1.0 / size)
        for done in range(0, max_rounds, PAGERANK_STRIDE):
            ranks = kept.write(matrix.following(ranks, min(PAGERANK_STRIDE, max_rounds - done), update))
            for step, change in enumerate(products.changes(ranks)):
                if change < size * tolerance:
                    return graph.with_terms(checkpoint(products.scores_of(ranks, step + 1)))
            ranks = ranks.mapInPandas(_last_vector, products.VECTORS)
        raise RuntimeError(f"PageRank did not converge in {max_rounds} rounds")


def _last_vector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(vectors=[products.vectors_of(data)[-1].tobytes() for data in batch["vectors"]])


# Vectors of the basis, and when to stop: how far, as a part of the eigenvalue, the matrix
# may turn the vector. What rounding leaves after many restarts is accepted if it is small.
EIGEN_BASIS = 6
EIGEN_RESTARTS = 100
EIGEN_TOLERANCE = 1e-13
EIGEN_ACCEPTED = 1e-9


def eigenvector(edges: DataFrame) -> DataFrame:
    """Leading eigenvector of the weight matrix, of unit length and positive.

    Restarted Lanczos: a few products with a vector span a space; the best eigenvector in
    it starts the next one. Its eigenvalue is taken off the matrix in the next products, so
    that what is left of the vector does not drown in rounding. Two eigenvalues of the same size but opposite signs, as
    bipartite graphs have, do no harm. A graph in several parts gets the limit of the
    iteration that starts from equal scores.
    """
    graph = BlockGraph(edges)
    if graph.size == 0:
        return graph.no_scores()
    directed = checkpoint(graph.directed())
    bound = directed.groupBy("a").agg(F.sum("weight").alias("degree")).agg(F.max("degree")).first()[0]

    def less(shift: float) -> products.Update:
        return lambda block, before, product: product / bound - shift * before[-1]

    with products.Products(graph, directed) as matrix, Rounds() as kept:
        vector, shift, turned = matrix.first(graph.size**-0.5), 0.0, None
        for _ in range(EIGEN_RESTARTS):
            basis = kept.write(matrix.following(vector, EIGEN_BASIS, less(shift)))
            before = turned
            weights, shift, turned = ritz_vector(products.triangle(basis), shift)
            vector = products.combined(basis, weights)
            settled = before is not None and turned >= before and turned < EIGEN_ACCEPTED
            if turned < EIGEN_TOLERANCE or settled:
                return graph.with_terms(_positive(checkpoint(products.scores_of(vector, 0))))
    raise RuntimeError("the eigenvector did not settle; its two leading eigenvalues are too close")


def ritz_vector(factor: np.ndarray, shift: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Weights of the best eigenvector in the space of some vectors, its eigenvalue, and how far it is from being one.

    ``factor`` is the triangular factor of the vectors, each the product of the one before,
    less ``shift`` times that. The space ends where a product adds nothing new.
    """
    size = 1
    while size < factor.shape[1] - 1 and abs(factor[size, size]) > 1e-13 * np.linalg.norm(factor[:, size]):
        size += 1
    own = factor[:, :size]
    moved = factor[:, 1 : size + 1] + shift * own
    inside = moved[:size] @ np.linalg.inv(own[:size])
    values, vectors = np.linalg.eigh((inside + inside.T) / 2)
    weights = np.linalg.solve(own[:size], vectors[:, -1])
    left = np.linalg.norm(moved @ weights - values[-1] * (own @ weights))
    return weights, float(values[-1]), float(left / values[-1])


def _positive(scores: DataFrame) -> DataFrame:
    sign = F.signum(scores.agg(F.sum("score")).scalar())
    return scores.select("node", (F.col("score") * sign).alias("score"))
