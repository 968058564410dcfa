"""Operators on a keyword graph: ``nodes(term, weight)`` and ``edges(src, dst, weight)``.

Joins leave the choice to Spark, which knows the size of written tables: small node tables
are broadcast, large ones shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.constants import (
    EDGE_EPSILON,
    EDGE_OFFSET,
    EDGE_PERCENTILE,
    FUNCTION_THRESHOLD,
    MEASURES,
    TOP_N,
)
from wordloom.operators import centrality
from wordloom.operators.cooc import drop_isolated
from wordloom.operators.terms import SORT_DECIMALS
from wordloom.session import numbered, running_sums


def centrality_by(edges: DataFrame, sort_by: str) -> DataFrame | None:
    """Scores ``(term, score)`` of the named measure; none for ``frequency``."""
    measures = {
        "frequency": None,
        "pagerank": centrality.pagerank,
        "betwenness": centrality.betweenness,
        "betweenness": centrality.betweenness,
        "weighted_degree": centrality.weighted_degree,
        "closeness": centrality.closeness,
        "eigenvector": centrality.eigenvector,
    }
    if sort_by not in measures:
        raise ValueError(f"unknown measure {sort_by!r}, use one of {MEASURES}")
    measure = measures[sort_by]
    return None if measure is None else measure(edges)


def top_terms(scores: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The ``top_n`` best terms; equal scores go by term."""
    return scores.orderBy(F.desc(F.round("score", SORT_DECIMALS)), "term").limit(top_n)


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``kept(term)``."""
    terms = kept.select("term")
    return (
        edges.join(terms.withColumnRenamed("term", "src"), "src", "left_semi")
        .join(terms.withColumnRenamed("term", "dst"), "dst", "left_semi")
        .select(*edges.columns)
    )


def weight_percentile(edges: DataFrame, part: float) -> DataFrame:
    """The exact percentile of the edges' weights, between two weights in proportion: one row ``(weight)``.

    Weights are counted, the distinct ones sorted in ranges, and counts added up inside a
    range and over the ranges, so no task holds all weights. The two ranks that the
    percentile lies between are looked up among the sums. Null without edges.
    """
    counts = edges.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    summed = running_sums(counts, "weight", "n", "before")
    place = F.lit(part) * (edges.agg(F.count(F.lit(1)).alias("n")).scalar() - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("weight"))).cast("double")

    found = summed.agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"))
    return found.select((F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("weight"))


def scale_edges(edges: DataFrame) -> DataFrame:
    """Add ``width`` and ``nor_weight`` to the edges.

    ``width`` is the weight scaled by the minimum and the 75th percentile, so it may
    pass its nominal top; ``nor_weight`` is the width scaled to 0..1, null if all edges
    weigh the same.
    """
    low = edges.agg(F.min("weight")).scalar()
    high = edges.agg(F.max("weight")).scalar()
    upper = weight_percentile(edges, EDGE_PERCENTILE).scalar()

    def width(weight):
        return (weight - low) / (upper - low + F.lit(EDGE_EPSILON)) + F.lit(EDGE_OFFSET)

    widths = edges.select("*", width(F.col("weight")).alias("width"))
    return widths.select(
        "*", F.try_divide(F.col("width") - width(low), width(high) - width(low)).alias("nor_weight")
    )


def threshold_edges(edges: DataFrame, above_weight: float = FUNCTION_THRESHOLD) -> DataFrame:
    """Edges with a ``nor_weight`` of at least ``above_weight``; null counts as below."""
    return edges.where(F.col("nor_weight") >= F.lit(above_weight))


def threshold_graph(
    nodes: DataFrame, edges: DataFrame, above_weight: float = FUNCTION_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph left by the threshold, isolated nodes dropped."""
    kept = threshold_edges(edges, above_weight)
    return drop_isolated(nodes, kept), kept


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with the group of their first end."""
    of_src = groups.select(F.col("term").alias("src"), "group")
    return edges.join(of_src, "src").select(*edges.columns, "group")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Modularity of a partition ``groups(term, group)``: one row ``(modularity)``."""
    of_src = groups.select(F.col("term").alias("src"), F.col("group").alias("src_group"))
    of_dst = groups.select(F.col("term").alias("dst"), F.col("group").alias("dst_group"))
    ends = (
        edges.join(of_src, "src").join(of_dst, "dst")
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("src_group").alias("group"), (F.col("src_group") == F.col("dst_group")).alias("inner"), "weight"),
                    F.struct(F.col("dst_group").alias("group"), (F.col("src_group") == F.col("dst_group")).alias("inner"), "weight"),
                )
            ).alias("end")
        )
        .groupBy("end.group")
        .agg(
            F.sum("end.weight").alias("total"),
            F.sum(F.when(F.col("end.inner"), F.col("end.weight")).otherwise(0)).alias("inside"),
        )
    )
    twice_m = F.sum("total")
    return ends.agg(
        (
            F.try_divide(F.sum("inside"), twice_m)
            - F.try_divide(F.sum(F.col("total").cast("double") * F.col("total")), twice_m.cast("double") * twice_m)
        ).alias("modularity")
    )


def partition_facts(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of what a good partition ``groups(term, group)`` of the graph must fulfil.

    ``n_terms`` terms have a group; ``once``: each term of the graph has one; ``numbered``:
    groups count from 0 in order of their smallest terms; ``settled``: no two linked groups
    gain by being one; ``beats_one`` and ``beats_singles``: modularity is not below that of one group
    and of groups of one term.
    """
    terms = edges.select(F.explode(F.array("src", "dst")).alias("term")).distinct()
    both = terms.join(groups.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "full")
    once = both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("n"), F.lit(0)) == 1), F.lit(True)).alias("v"))
    firsts = groups.groupBy("group").agg(F.min("term").alias("first"))
    wanted = number_groups(groups.select("term", F.col("group").alias("label")))
    same = groups.join(wanted.withColumnRenamed("group", "wanted"), "term").agg(F.coalesce(F.bool_and(F.col("group") == F.col("wanted")), F.lit(True)).alias("v"))
    ends = group_edges(edges, groups).withColumnRenamed("group", "g")
    ends = ends.join(groups.select(F.col("term").alias("dst"), F.col("group").alias("h")), "dst")
    totals = ends.select(F.explode(F.array("g", "h")).alias("g"), "weight").groupBy("g").agg(F.sum("weight").cast("double").alias("total"))
    twice_m = totals.agg(F.sum("total")).scalar()
    between = ends.where("g <> h").groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.sum("weight").alias("tie"))
    merges = between.join(totals, "g").join(totals.select(F.col("g").alias("h"), F.col("total").alias("other")), "h")
    gain = F.col("tie") / twice_m - F.col("total") * F.col("other") / (twice_m * twice_m)
    settled = merges.agg(F.coalesce(F.max(gain) <= 1e-6, F.lit(True)).alias("v"))
    own = modularity(edges, groups).scalar()
    one = modularity(edges, terms.withColumn("group", F.lit(0))).scalar()
    singles = modularity(edges, terms.withColumn("group", F.xxhash64("term"))).scalar()
    return firsts.agg(
        groups.agg(F.count(F.lit(1))).scalar().alias("n_terms"),
        once.scalar().alias("once"),
        same.scalar().alias("numbered"),
        settled.scalar().alias("settled"),
        F.coalesce(own >= one - 1e-9, F.lit(True)).alias("beats_one"),
        F.coalesce(own >= singles - 1e-9, F.lit(True)).alias("beats_singles"),
    )


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one node-link JSON object, in a one-row table ``(json)``.

    One string holds the whole graph, so this is for graphs of a few thousand links, such
    as those of a top-n; ``node_link_lines`` is for any size.
    """
    node_list = nodes.agg(
        F.array_sort(F.collect_list(F.struct(F.col("term").alias("id"), "weight", "group"))).alias("nodes")
    )
    link_list = edges.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "nor_weight", "group"
                )
            )
        ).alias("links")
    )
    return node_list.select(
        F.to_json(
            F.struct(
                F.lit(False).alias("directed"),
                F.lit(False).alias("multigraph"),
                F.create_map().cast("map<string,string>").alias("graph"),
                F.col("nodes"),
                link_list.scalar().alias("links"),
            )
        ).alias("json")
    )


def node_link_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as the lines of one node-link JSON document: ``(part, first, second, line)``.

    The lines in order of the other columns are the document: an opening, one node or link
    a line, a closing. A comma stands before every node and link but the first of its list,
    so no row needs to know the end of its list, and no row or task holds the whole graph.
    """
    spark = nodes.sparkSession
    node = F.to_json(F.struct(F.col("term").alias("id"), "weight", "group"))
    link = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "nor_weight", "group"))
    first_node = nodes.agg(F.min("term")).scalar()
    first_link = edges.agg(F.min(F.struct("src", "dst"))).scalar()
    comma = lambda key, first: F.when(key == first, "").otherwise(",")
    node_rows = nodes.select(
        F.lit(1).alias("part"), F.col("term").alias("first"), F.lit("").alias("second"), F.concat(comma(F.col("term"), first_node), node).alias("line")
    )
    link_rows = edges.select(
        F.lit(3).alias("part"), F.col("src").alias("first"), F.col("dst").alias("second"), F.concat(comma(F.struct("src", "dst"), first_link), link).alias("line")
    )
    frame = [(0, '{"directed":false,"multigraph":false,"graph":{},"nodes":['), (2, '],"links":['), (4, "]}")]
    frame_rows = spark.createDataFrame([(part, "", "", line) for part, line in frame], "part int, first string, second string, line string")
    return frame_rows.unionByName(node_rows).unionByName(link_rows)


def number_groups(labels: DataFrame) -> DataFrame:
    """Groups ``(term, label)`` renumbered from 0 by their smallest term: ``(term, group)``."""
    firsts = labels.groupBy("label").agg(F.min("term").alias("first"))
    groups = numbered(firsts, "first", "group").select("label", F.col("group").cast("long").alias("group"))
    return labels.join(groups, "label").select("term", "group")
