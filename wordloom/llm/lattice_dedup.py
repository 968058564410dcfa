"""Near-duplicate vectors by lattice hashing.

Vectors are projected to points of eight dimensions, twice for each of several tables, and
decoded to E8 lattice points; a table's cell is a pair of points. A vector lies in its
home cells and probes the neighbouring lattice cells nearest to it. Candidates come from
shared cells and are verified by cosine.

Pairs inside a dense group are not written out. Vectors within half of the largest linked
angle of one centre form a ball: by the triangle inequality all of them are linked. Balls
that share a cell are compared: a vector whose angle to the other centre, with the ball's
radius added, is within the limit is linked to the whole ball, and one that stays beyond
it with the radius taken off to none of it; only what lies between is compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import struct
from wordloom.llm.components import components
from wordloom.llm.lattice import DIMS, cells
from wordloom.session import checkpoint

COSINE = 0.9
TABLES = 24
POINTS = 2
NEIGHBOURS = 3
SCALE = 1.75
SEED = 3
# Angles are compared with this much to spare; what is closer is compared by cosine.
SPARE = 1e-7


@F.pandas_udf(struct(wl_class=T.BinaryType(), wl_unit=T.BinaryType()))
def prepared(vectors: pd.Series) -> pd.DataFrame:
    """Digest and unit vector (doubles) of usable vectors, nulls of others."""
    rows = []
    for vector in vectors:
        try:
            values = None if vector is None else np.asarray(vector, np.float64)
        except (TypeError, ValueError):
            values = None
        length = 0.0 if values is None or not len(values) or not np.isfinite(values).all() else np.abs(values).max()
        if not length:
            rows.append((None, None))
            continue
        values = values / length
        unit = (values / np.sqrt((values * values).sum())).tobytes()
        rows.append((xxhash.xxh3_128_digest(unit), unit))
    return pd.DataFrame(rows, columns=["wl_class", "wl_unit"])


def units_of(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x) for x in column])


def cell_rows(nodes: DataFrame, tables: int, scale: float, neighbours: int) -> DataFrame:
    """``wl_node, wl_cell, wl_home``: home cells and probed cells of every vector."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, same in batch.groupby(batch["wl_unit"].map(len)):
                unit, node = units_of(same["wl_unit"]), same["wl_node"].to_numpy()
                random = np.random.default_rng((SEED, size))
                for table in range(tables):
                    points = [cells(unit @ random.normal(size=(unit.shape[1], DIMS)) / scale, neighbours) for _ in range(POINTS)]
                    ways = [(0, 0)] + [(k, 0) for k in range(1, neighbours + 1)] + [(0, k) for k in range(1, neighbours + 1)]
                    for way in ways:
                        code = np.concatenate([points[p][:, k] for p, k in enumerate(way)], 1).astype(np.int16)
                        name = f"{size},{table}".encode()
                        cell = [xxhash.xxh3_64_intdigest(name + row.tobytes()) for row in code]
                        yield pd.DataFrame({"wl_node": node, "wl_cell": np.array(cell, np.uint64).view(np.int64), "wl_home": way == (0, 0)})

    return nodes.select("wl_node", "wl_unit").mapInPandas(find, "wl_node long, wl_cell long, wl_home boolean")


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of unit vectors; -1 for different lengths."""
    return pd.Series([float(np.frombuffer(x) @ np.frombuffer(y)) if len(x) == len(y) else -1.0 for x, y in zip(a, b, strict=True)], dtype=float)


def vector_links(
    vectors: DataFrame,
    vector: str = "embedding",
    limit: float = COSINE,
    tables: int = TABLES,
    scale: float = SCALE,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors``.

    ``vectors`` needs ``vec_id`` and the array column ``vector``; others are not read.
    ``n_links`` counts the other rows whose vector has a cosine of ``limit`` or more,
    ``component_id`` is the least ``vec_id`` that links reach. Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, vectors of
    different lengths not with each other. Equal vectors are one vector with a count.
    Rows that repeat a ``vec_id`` are vectors of their own. Rows without a ``vec_id``
    take part; their component is that of their vector, null if no id is in it. An empty
    table gives an empty one.
    """
    widest = float(np.arccos(limit))
    rows = checkpoint(vectors.select("vec_id", prepared(vector).alias("wl_p")).select("vec_id", "wl_p.*"))
    classes = rows.where("wl_class is not null").groupBy("wl_class").agg(F.count("*").alias("wl_size"), F.min("vec_id").alias("wl_first"), F.min("wl_unit").alias("wl_unit"))
    nodes = checkpoint(classes.withColumn("wl_node", F.monotonically_increasing_id()))
    places = checkpoint(cell_rows(nodes, tables, scale, neighbours))
    units = nodes.select("wl_node", "wl_unit")

    homes = places.where("wl_home").select("wl_cell", "wl_node")
    hubs = homes.groupBy("wl_cell").agg(F.min("wl_node").alias("wl_hub"), F.max("wl_node").alias("wl_last")).where("wl_hub < wl_last")
    star = checkpoint(homes.join(hubs, "wl_cell").where("wl_node <> wl_hub").select("wl_node", "wl_hub").distinct())
    near = star.join(units, "wl_node").join(units.toDF("wl_hub", "wl_hub_unit"), "wl_hub")
    near = near.select("wl_node", "wl_hub", F.acos(F.least(F.lit(1.0), cosine("wl_unit", "wl_hub_unit"))).alias("wl_angle"))
    nearest = near.where(F.col("wl_angle") <= widest / 2 - SPARE).groupBy("wl_node").agg(F.min(F.struct("wl_hub", "wl_angle")).alias("wl_to"))
    in_ball = nodes.join(nearest, "wl_node", "left").select(
        "wl_node",
        "wl_size",
        F.coalesce("wl_to.wl_hub", "wl_node").alias("wl_ball"),
        F.coalesce("wl_to.wl_angle", F.lit(0.0)).alias("wl_angle"),
    )
    in_ball = checkpoint(in_ball)
    balls = in_ball.groupBy("wl_ball").agg(F.sum("wl_size").alias("wl_total"), F.count("*").alias("wl_members"), F.max("wl_angle").alias("wl_radius"))
    balls = checkpoint(balls.join(units.toDF("wl_ball", "wl_centre"), "wl_ball"))

    held = in_ball.select("wl_node", "wl_ball")
    home_balls = homes.join(held, "wl_node").select("wl_cell", F.col("wl_ball").alias("wl_a")).distinct()
    probe_balls = places.join(held, "wl_node").select("wl_cell", F.col("wl_ball").alias("wl_b")).distinct()
    met = home_balls.join(probe_balls, "wl_cell").where("wl_a <> wl_b")
    pairs = checkpoint(met.select(F.least("wl_a", "wl_b").alias("wl_a"), F.greatest("wl_a", "wl_b").alias("wl_b")).distinct())
    side = lambda end: balls.select(F.col("wl_ball").alias(f"wl_{end}"), F.col("wl_radius").alias(f"wl_r_{end}"), F.col("wl_centre").alias(f"wl_c_{end}"))
    apart = F.acos(F.least(F.lit(1.0), cosine("wl_c_a", "wl_c_b")))
    close = pairs.join(side("a"), "wl_a").join(side("b"), "wl_b").withColumn("wl_apart", apart)
    close = checkpoint(close.where(F.col("wl_apart") <= F.col("wl_r_a") + F.col("wl_r_b") + widest + SPARE).select("wl_a", "wl_b"))

    both = close.unionByName(close.select(F.col("wl_b").alias("wl_a"), F.col("wl_a").alias("wl_b")))
    other = balls.select(F.col("wl_ball").alias("wl_b"), "wl_radius", "wl_centre", "wl_total", "wl_members")
    facing = both.join(in_ball.select("wl_node", F.col("wl_ball").alias("wl_a")), "wl_a").join(units, "wl_node").join(other, "wl_b")
    facing = facing.withColumn("wl_cosine", cosine("wl_unit", "wl_centre"))
    angle = F.acos(F.least(F.lit(1.0), F.col("wl_cosine")))
    alone = (F.col("wl_members") == 1) & (F.col("wl_radius") == 0)
    verdict = (
        F.when(alone, F.when(F.col("wl_cosine") >= limit, 1).otherwise(0))
        .when(angle + F.col("wl_radius") <= widest - SPARE, 1)
        .when(angle - F.col("wl_radius") > widest + SPARE, 0)
    )
    judged = checkpoint(facing.select("wl_node", "wl_a", "wl_b", "wl_total", verdict.alias("wl_verdict")))
    whole = judged.where("wl_verdict = 1").select("wl_node", "wl_a", "wl_b", F.col("wl_total").alias("wl_links"))
    members = in_ball.select(F.col("wl_node").alias("wl_other"), F.col("wl_ball").alias("wl_b"), "wl_size").join(units.toDF("wl_other", "wl_other_unit"), "wl_other")
    single = judged.where("wl_verdict is null").select("wl_node", "wl_a", "wl_b").join(units, "wl_node").join(members, "wl_b")
    single = single.where(cosine("wl_unit", "wl_other_unit") >= limit)
    single = single.groupBy("wl_node", "wl_a", "wl_b").agg(F.sum("wl_size").alias("wl_links"))
    linked = checkpoint(whole.unionByName(single))

    label = components(linked.select("wl_a", "wl_b"), "wl_a", "wl_b").toDF("wl_ball", "wl_component")
    grouped = in_ball.join(label, "wl_ball", "left").select("wl_node", "wl_ball", F.coalesce("wl_component", "wl_ball").alias("wl_component"))
    least = grouped.join(nodes.select("wl_node", "wl_first"), "wl_node").groupBy("wl_component").agg(F.min("wl_first").alias("wl_least"))
    outside = linked.groupBy("wl_node").agg(F.sum("wl_links").alias("wl_links"))
    per_node = grouped.join(least, "wl_component").join(balls.select("wl_ball", "wl_total"), "wl_ball").join(outside, "wl_node", "left")
    per_node = per_node.join(nodes.select("wl_node", "wl_class"), "wl_node")
    per_node = per_node.select("wl_class", "wl_least", (F.col("wl_total") - 1 + F.coalesce("wl_links", F.lit(0))).alias("n_links"))
    result = rows.select("vec_id", "wl_class").join(per_node, "wl_class", "left")
    component = F.when(F.col("wl_class").isNull(), F.col("vec_id")).otherwise(F.col("wl_least"))
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
