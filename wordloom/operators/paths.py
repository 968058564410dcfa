"""Shortest paths by frontiers, for some sources at a time.

A wave of sources is cut into batches. For a batch and a range of nodes there is one row, with a
line for each node and a column for each source. In a round only the lines that
changed are sent along the edges to other ranges; inside its own range a task follows
changes to their end. So what a round moves is bounded by the sources of a wave times the
nodes that changed, and edges are read as they are, not as a matrix.

Numbers of shortest paths spread from the sources over the edges that are tight, that is
as long as the distances of their ends differ; every number that arrives is passed on
once. The shares of paths that go through a node come back over the same edges.
Weights are distances and must be above 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.blocks import WIDTH, BlockGraph, Tile, packed_tiles
from wordloom.session import Collected, Rounds, checkpoint

# Sources of a batch, which divide a range, and batches of a wave.
BATCH = 64
WAVE = 64

STATE = "batch int, block int, dist binary, total binary, nodes binary, values binary"
SENT = "batch int, block int, nodes binary, values binary, from_dist binary"
EDGES = ["u", "v", "w"]

Step = Callable[[tuple, pd.DataFrame], pd.DataFrame]


def lines(data: bytes) -> np.ndarray:
    """Numbers by node and source."""
    return np.frombuffer(data).reshape(-1, BATCH)


def places(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int16)


def split_group(rows: pd.DataFrame) -> tuple[dict, list[dict]]:
    """A batch's own row for a range, with the edges inside the range, and the messages to it."""
    records = rows.to_dict("records")
    return next(r for r in records if r["own"]), [r for r in records if not r["own"]]


def state_row(key: tuple, dist: np.ndarray, total: np.ndarray | None, nodes: np.ndarray, values: np.ndarray | None) -> pd.DataFrame:
    """A row of the state; ``nodes`` are the lines to be sent on, with ``values``."""
    binary = [None if array is None else array.tobytes() for array in (dist, total, nodes.astype(np.int16), values)]
    return pd.DataFrame([(*key, *binary)], columns=["batch", "block", "dist", "total", "nodes", "values"], dtype=object)


def extend(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Distances after the messages and all steps inside the range."""
    own, messages = split_group(rows)
    dist = np.full((WIDTH, BATCH), np.inf) if own["dist"] is None else lines(own["dist"]).copy()
    changed = np.zeros(WIDTH, bool)

    def relax(edges: Tile, nodes: np.ndarray, far: np.ndarray) -> np.ndarray:
        better = np.zeros(WIDTH, bool)
        for k, _, ends, weights in edges.onward(nodes):
            longer, now = far[k] + weights[:, None], dist[ends]
            shorter = (longer < now).any(axis=1)
            if shorter.any():
                dist[ends[shorter]] = np.minimum(now[shorter], longer[shorter])
                better[ends[shorter]] = True
        return better

    first_source = key[0] * BATCH
    if own["nodes"] is None and first_source // WIDTH == key[1]:
        sources = first_source % WIDTH + np.arange(BATCH)
        dist[sources, np.arange(BATCH)] = 0.0
        changed[sources] = True
    for message in messages:
        changed |= relax(Tile.of(message), places(message["nodes"]), lines(message["from_dist"]))
    inner, frontier = Tile.of(own), changed
    while frontier.any():
        nodes = np.flatnonzero(frontier)
        frontier = relax(inner, nodes, dist[nodes])
        changed = changed | frontier
    return state_row(key, dist, None, np.flatnonzero(changed), None)


def spreading(reverse: bool) -> Step:
    """The step that passes numbers on over tight edges, towards the sources if ``reverse``."""

    def spread(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, messages = split_group(rows)
        dist = lines(own["dist"])
        total = np.zeros((WIDTH, BATCH)) if own["total"] is None else lines(own["total"]).copy()

        def tight(far: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
            if reverse:
                return dist[ends] + weights[:, None] == far
            return far + weights[:, None] == dist[ends]

        def arrivals(edges: Tile, nodes: np.ndarray, far: np.ndarray, values: np.ndarray, to: np.ndarray) -> None:
            for k, _, ends, weights in edges.onward(nodes):
                to[ends] += np.where(tight(far[k], ends, weights), values[k], 0.0)

        news = np.zeros((WIDTH, BATCH))
        for message in messages:
            arrivals(Tile.of(message), places(message["nodes"]), lines(message["from_dist"]), lines(message["values"]), news)
        total += news
        if own["nodes"] is None:
            news = lines(own["values"])
        sent = news.copy()
        if news.any():
            inner = tight_edges(Tile.of(own), dist, tight)
            while news.any():
                nodes = np.flatnonzero(news.any(axis=1))
                following = np.zeros((WIDTH, BATCH))
                arrivals(inner, nodes, dist[nodes], news[nodes], following)
                news = following
                total += news
                sent += news
        nodes = np.flatnonzero(sent.any(axis=1))
        return state_row(key, dist, total, nodes, sent[nodes])

    return spread


def tight_edges(edges: Tile, dist: np.ndarray, tight: Callable[..., np.ndarray]) -> Tile:
    """The edges inside a range that are tight for any source."""
    kept = np.zeros(len(edges.u), bool)
    for _, node, ends, weights in edges.onward(np.arange(WIDTH)):
        found = (tight(dist[node], ends, weights) & np.isfinite(dist[node])).any(axis=1)
        kept[edges.starts[node] : edges.starts[node + 1]] = found
    return edges.where(kept)


def changed_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a row of the state sends: its changed lines, with their distances."""
    for batch in batches:
        dist = [lines(d)[places(n)].tobytes() for d, n in zip(batch["dist"], batch["nodes"], strict=True)]
        yield batch[["batch", "block", "nodes", "values"]].assign(from_dist=dist)


class Waves:
    """The tiles of a graph, and the states of its waves of sources."""

    def __init__(self, graph: BlockGraph):
        self.graph, self.side = graph, graph.side
        tiles = checkpoint(packed_tiles(graph.directed(), shortest=True))
        self.inner = tiles.where("bi = bj").select(F.col("bi").alias("block"), *EDGES)
        self.outer = tiles.where("bi <> bj").select(F.col("bi").alias("block"), "bj", *EDGES)

    def starts(self) -> Iterator[DataFrame]:
        """A first state for every wave: a row for each batch and range, without distances."""
        batches = -(-self.graph.size // BATCH)
        for first in range(0, batches, WAVE):
            rows = self.graph.numbered.sparkSession.range(first * self.side, min(batches, first + WAVE) * self.side)
            place = [F.floor(F.col("id") / self.side).cast("int").alias("batch"), (F.col("id") % self.side).cast("int").alias("block")]
            yield rows.select(*place, *[F.lit(None).cast("binary").alias(name) for name in ("dist", "total", "nodes", "values")])

    def settled(self, state: DataFrame, step: Step, kept: Rounds) -> DataFrame:
        """The state when no line changes any more."""
        parts = 2 * min(WAVE, -(-self.graph.size // BATCH)) * self.side
        no_distances = F.lit(None).cast("binary").alias("from_dist")

        def run(state: DataFrame, messages: DataFrame | None) -> DataFrame:
            rows = state.join(self.inner, "block", "left").select(*state.columns, no_distances, *EDGES, F.lit(True).alias("own"))
            if messages is not None:
                rows = rows.unionByName(messages.withColumn("own", F.lit(False)), allowMissingColumns=True)
            return kept.write(rows.repartition(parts, "batch", "block").groupBy("batch", "block").applyInPandas(step, STATE))

        state = run(state, None)
        while self.side > 1:
            sending = state.where(F.length("nodes") > 0)
            if sending.isEmpty():
                break
            messages = sending.mapInPandas(changed_lines, SENT).join(self.outer, "block").drop("block").withColumnRenamed("bj", "block")
            state = run(state, messages)
        return state

    def distances(self, kept: Rounds) -> Iterator[DataFrame]:
        """The settled distances of every wave; each takes the place of the last."""
        for start in self.starts():
            yield self.settled(start, extend, kept)


def by_lines(state: DataFrame, work: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``work(batch, block, *columns)`` on every row of a state, with its numbers by node and source."""
    names = [name for name in state.columns if name not in ("batch", "block")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield work(row["batch"], row["block"], *[lines(row[name]) for name in names])

    return state.mapInPandas(rows, schema)


def reach(graph: BlockGraph) -> DataFrame:
    """Number of other nodes a node reaches and the sum of the distances: ``(node, reached, total)``."""

    def sums(batch: int, block: int, dist: np.ndarray) -> pd.DataFrame:
        held = np.isfinite(dist) & (dist > 0)
        total = np.where(held, dist, 0.0).sum(axis=0)
        return pd.DataFrame({"node": batch * BATCH + np.arange(BATCH), "reached": held.sum(axis=0).astype(float), "total": total})

    schema = "node int, reached double, total double"
    found = Collected(graph.numbered.sparkSession, schema)
    with Rounds() as kept:
        for state in Waves(graph).distances(kept):
            parts = by_lines(state.select("batch", "block", "dist"), sums, schema)
            found.add(parts.groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total")))
        kept.drop()
    return found.table()


def distance_pairs(graph: BlockGraph) -> DataFrame:
    """Distances of all connected pairs: ``(src, dst, dist)`` with ``src < dst``."""

    def cells(batch: int, block: int, dist: np.ndarray) -> pd.DataFrame:
        b, a = np.nonzero(np.isfinite(dist))
        found = pd.DataFrame({"a": batch * BATCH + a, "b": block * WIDTH + b, "dist": dist[b, a]})
        return found[found["a"] < found["b"]]

    schema = "a int, b int, dist double"
    found = Collected(graph.numbered.sparkSession, schema)
    if graph.size:
        with Rounds() as kept:
            for state in Waves(graph).distances(kept):
                found.add(by_lines(state.select("batch", "block", "dist"), cells, schema))
            kept.drop()
    number = graph.numbered
    return (
        found.table().join(number.select(F.col("node").alias("a"), F.col("term").alias("src")), "a")
        .join(number.select(F.col("node").alias("b"), F.col("term").alias("dst")), "b")
        .select("src", "dst", "dist")
    )


def first_values(state: DataFrame, values: Column) -> DataFrame:
    """A state that begins with ``values`` to be passed on."""
    none = F.lit(None).cast("binary")
    return state.select("batch", "block", "dist", none.alias("total"), none.alias("nodes"), values.alias("values"))


def dependencies(graph: BlockGraph) -> DataFrame:
    """Sum, over all ordered pairs, of the share of shortest paths through a node: ``(node, through)``.

    With s(v) shortest paths from a source to v, the share of v's paths that one tight
    edge before it carries is 1 / s(v) for each path to the edge's start. So 1 / s(v) comes back
    over all tight edges, and what arrives at a node, times its own paths, is its share of
    the paths to all nodes behind it.
    """

    @F.pandas_udf("binary")
    def at_source(dist: pd.Series) -> pd.Series:
        return pd.Series([(lines(d) == 0).astype(float).tobytes() for d in dist], dtype=object)

    @F.pandas_udf("binary")
    def all_paths(dist: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([(lines(t) + (lines(d) == 0)).tobytes() for d, t in zip(dist, total, strict=True)], dtype=object)

    @F.pandas_udf("binary")
    def inverse(paths: pd.Series) -> pd.Series:
        shares = [np.divide(1.0, lines(p), out=np.zeros_like(lines(p)), where=lines(p) > 0) for p in paths]
        return pd.Series([s.tobytes() for s in shares], dtype=object)

    def through(batch: int, block: int, dist: np.ndarray, paths: np.ndarray, back: np.ndarray) -> pd.DataFrame:
        share = np.where(dist > 0, paths * back, 0.0).sum(axis=1)
        return pd.DataFrame({"node": block * WIDTH + np.arange(WIDTH), "through": share})

    schema = "node int, through double"
    found = Collected(graph.numbered.sparkSession, schema)
    waves = Waves(graph)
    with Rounds() as far, Rounds() as forward, Rounds() as counted, Rounds() as backward:
        for dist in waves.distances(far):
            spread = waves.settled(first_values(dist, at_source("dist")), spreading(False), forward)
            paths = counted.write(spread.select("batch", "block", "dist", all_paths("dist", "total").alias("paths")))
            back = waves.settled(first_values(paths, inverse("paths")), spreading(True), backward)
            both = paths.join(back.select("batch", "block", F.col("total").alias("back")), ["batch", "block"])
            shares = by_lines(both.select("batch", "block", "dist", "paths", "back"), through, schema)
            found.add(shares.groupBy("node").agg(F.sum("through").alias("through")))
        for kept in (far, forward, counted, backward):
            kept.drop()
    return found.table().groupBy("node").agg(F.sum("through").alias("through"))
