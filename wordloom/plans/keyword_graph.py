"""From documents to the clustered keyword graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.constants import MAX_FEATURES, MIN_DF, PIPELINE_THRESHOLD, TOP_N
from wordloom.operators.communities import communities
from wordloom.operators.cooc import cooccurrence, drop_isolated, edges_above, node_weights
from wordloom.operators.graph import (
    centrality_by,
    group_edges,
    scale_edges,
    subgraph,
    threshold_graph,
    top_terms,
)
from wordloom.operators.terms import counted_documents, split_single_document, vocab_pruned
from wordloom.session import checkpoint


@dataclass(frozen=True)
class KeywordGraph:
    """``nodes`` and ``edges`` before the threshold, ``kept_*`` after it with groups.

    ``nodes(term, weight)``, ``edges(src, dst, weight, nor_weight)``; the kept tables
    add ``group``. An empty corpus gives empty tables.
    """

    nodes: DataFrame
    edges: DataFrame
    kept_nodes: DataFrame
    kept_edges: DataFrame


def term_cells(
    docs: DataFrame,
    min_df: float = MIN_DF,
    max_features: int = MAX_FEATURES,
    binary: bool = False,
    min_token_len: int = 2,
) -> DataFrame:
    """Co-occurrence cells of the pruned vocabulary; reads the texts once."""
    counts = counted_documents(split_single_document(docs), min_token_len)
    vocab = checkpoint(vocab_pruned(counts, min_df, max_features))
    return checkpoint(cooccurrence(counts, vocab, binary))


def top_graph(cells: DataFrame, sort_by: str, top_n: int, min_count: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(term, weight)`` and scaled edges of the ``top_n`` terms by a measure.

    The measure sees the whole graph; ``frequency`` keeps every term that has an edge.
    """
    edges = edges_above(cells, min_count)
    nodes = node_weights(cells).select("term", "weight")
    scores = centrality_by(edges, sort_by)
    if scores is None:
        nodes = drop_isolated(nodes, edges)
    else:
        kept = checkpoint(top_terms(scores, top_n))
        nodes = nodes.join(kept.select("term"), "term", "left_semi")
        edges = subgraph(edges, kept)
    return checkpoint(nodes), checkpoint(scale_edges(edges).drop("width"))


def keyword_graph(
    docs: DataFrame,
    sort_by: str = "closeness",
    top_n: int = TOP_N,
    above_weight: float = PIPELINE_THRESHOLD,
    min_count: int = 0,
    min_df: float = MIN_DF,
    max_features: int = MAX_FEATURES,
    binary: bool = False,
    min_token_len: int = 2,
) -> KeywordGraph:
    """The keyword graph of ``docs(doc_id, text)``: top terms, threshold, communities."""
    cells = term_cells(docs, min_df, max_features, binary, min_token_len)
    nodes, edges = top_graph(cells, sort_by, top_n, min_count)
    kept_nodes, kept_edges = threshold_graph(nodes, edges, above_weight)
    groups = communities(kept_edges)
    return KeywordGraph(
        nodes, edges, kept_nodes.join(groups, "term"), group_edges(kept_edges, groups)
    )
