"""Louvain communities by rounds of joins and sums.

A round works out every node's best move at once and takes those that surely raise
modularity even though all are made together:

1. A community is a source or a target for the round, whichever its best move makes it.
   Only moves from a source to a target count, so no two nodes swap places.
2. Moves into one target, and out of one source, are ranked by gain, in classes of about
   equal gain. Each must still gain if all others of its own and better classes are made
   first; the best move of a community need not. Links among the movers are left out of
   that test and can only add to the gain.

The best move of all always passes, so modularity rises each round until no move gains.
Then communities become nodes and the rounds start again. What is gathered for a
community is one sum for each class, so one with very many moves is no burden to a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.centrality import both_ways
from wordloom.operators.graph import number_groups
from wordloom.session import Rounds, checkpoint

# Gains below this part of the total weight are rounding noise.
GAIN_EPSILON = 1e-9
# Classes of gains: so many to a halving, and in all.
CLASSES_A_HALVING = 4
CLASSES = 64


def communities(edges: DataFrame) -> DataFrame:
    """Groups ``(term, group)`` of all terms with an edge, numbered by smallest term."""
    with Rounds() as kept_links, Rounds() as kept_members:
        links = kept_links.write(both_ways(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))
        twice_m = links.agg(F.sum("weight")).first()[0]
        members = links.select(F.col("a").alias("term"), F.col("a").alias("label")).distinct()
        if twice_m is None:
            return members.select("term", F.lit(None).cast("long").alias("group"))
        while True:
            with Rounds() as kept_places:
                level = _one_level(links, float(twice_m), kept_places)
                if level is None:
                    kept_places.drop()
                    groups = checkpoint(number_groups(members))
                    kept_links.drop()
                    kept_members.drop()
                    return groups
                # Communities take the place of nodes; a link inside one becomes a loop.
                members = kept_members.write(
                    members.join(level.withColumnRenamed("node", "label"), "label").select("term", F.col("community").alias("label"))
                )
                to_a = level.select(F.col("node").alias("a"), F.col("community").alias("ca"))
                to_b = level.select(F.col("node").alias("b"), F.col("community").alias("cb"))
                links = kept_links.write(
                    links.join(to_a, "a").join(to_b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight"))
                )
                kept_places.drop()


def _one_level(links: DataFrame, twice_m: float, kept: Rounds) -> DataFrame | None:
    """Communities ``(node, community)`` once no single move gains, or none if none ever did."""
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").cast("double").alias("degree"))
    place = kept.write(degrees.select("node", F.col("node").alias("community"), "degree", F.col("degree").alias("total")))
    moved = False
    with Rounds() as kept_gains:
        while True:
            gains = kept_gains.write(_gains(links, place, twice_m))
            if gains.isEmpty():
                kept_gains.drop()
                return place.select("node", "community") if moved else None
            moved = True
            moves = _safe_moves(gains, twice_m)
            after = place.join(moves, "node", "left").select("node", F.coalesce("target", "community").alias("community"), "degree")
            totals = after.groupBy("community").agg(F.sum("degree").alias("total"))
            place = kept.write(after.join(totals, "community").select("node", "community", "degree", "total"))


def _gains(links: DataFrame, place: DataFrame, twice_m: float) -> DataFrame:
    """The best move of every node that gains by one: ``(node, source, target, degree, gain)``.

    ``place`` is ``(node, community, degree, total)``, ``total`` being the community's
    degrees taken together.
    """
    of_neighbour = place.select(F.col("node").alias("b"), F.col("community").alias("target"), F.col("total").alias("target_total"))
    own = place.withColumnsRenamed({"community": "source", "total": "source_total"})
    ties = (
        links.where(F.col("a") != F.col("b")).join(of_neighbour, "b")
        .groupBy(F.col("a").alias("node"), "target", "target_total")
        .agg(F.sum("weight").cast("double").alias("tie"))
        .join(own, "node")
    )
    stays = F.col("target") == F.col("source")
    others = F.col("target_total") - F.when(stays, F.col("degree")).otherwise(0.0)
    pull = ties.withColumn("pull", F.col("tie") - F.col("degree") * others / F.lit(twice_m))
    best = pull.groupBy("node", "source", "degree", "source_total").agg(
        F.max(F.when(stays, F.col("pull"))).alias("stay"),
        F.min_by(
            F.struct("target", "pull"), F.when(~stays, F.struct(-F.round("pull", 9), F.col("target")))
        ).alias("out"),
    )
    # A node without a link into its own community is not tied to it but pushed away.
    unlinked = -F.col("degree") * (F.col("source_total") - F.col("degree")) / F.lit(twice_m)
    return best.select(
        "node", "source", "out.target", "degree", (F.col("out.pull") - F.coalesce("stay", unlinked)).alias("gain")
    ).where(F.col("gain") > F.lit(GAIN_EPSILON * twice_m))


def _safe_moves(gains: DataFrame, twice_m: float) -> DataFrame:
    """Moves ``(node, target)`` out of ``gains`` that can all be made in one round."""
    top = gains.agg(F.max("gain")).scalar()
    halvings = F.floor(F.log2(top / F.col("gain")) * CLASSES_A_HALVING)
    ranked = gains.withColumn("class", F.least(halvings, F.lit(CLASSES - 1)).cast("int"))
    # Each move touches two communities; whichever side the best move takes is the
    # community's role for the round.
    ends = F.array(
        F.struct(F.col("source").alias("community"), F.lit(True).alias("leaves")),
        F.struct(F.col("target").alias("community"), F.lit(False).alias("leaves")),
    )
    order = F.struct(-F.round("gain", 9), F.col("node"))
    touching = ranked.select("class", "degree", order.alias("order"), F.explode(ends).alias("end"))
    sums = touching.groupBy("end", "class").agg(F.sum("degree").alias("sum"), F.min("order").alias("first"))
    lists = sums.groupBy("end.community").agg(
        F.min_by("end.leaves", "first").alias("leaves"),
        F.min("first").alias("first"),
        F.collect_list(F.struct("end.leaves", "class", "sum")).alias("sums"),
    )
    found = ranked
    before = F.lit(0.0)
    for end, leaves in (("source", True), ("target", False)):
        side = lists.where(F.col("leaves") == leaves)
        found = found.join(side.select(F.col("community").alias(end), F.col("first").alias(f"{end}_first"), F.col("sums").alias(f"{end}_sums")), end)
        so_far = F.aggregate(F.filter(f"{end}_sums", no_worse(leaves)), F.lit(0.0), lambda total, entry: total + entry["sum"])
        before = before + F.when(F.col(f"{end}_first") == order, 0.0).otherwise(so_far - F.col("degree"))
    still = F.col("gain") - F.col("degree") * before / F.lit(twice_m)
    return found.where(still > F.lit(GAIN_EPSILON * twice_m)).select("node", "target")


def no_worse(leaves: bool) -> Callable[[Column], Column]:
    """Whether a list's entry is on the side ``leaves`` and of the row's class or a better one."""
    return lambda entry: (entry["leaves"] == leaves) & (entry["class"] <= F.col("class"))
