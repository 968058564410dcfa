"""Reading landed tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table; with ``spread_by``, dealt out anew by that column.

    A file with one row group is read by one task. Spreading is for callers who know that
    their table lies in a few such files; it shuffles the table. Into how many partitions
    is Spark's choice.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table if spread_by is None else table.repartition(spread_by)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as two parquet tables below ``folder``."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def write_json_text(json: DataFrame, folder: str) -> None:
    """A one-column table of JSON strings as text files, non-ASCII characters kept."""
    json.write.mode("overwrite").text(folder)


def write_lines(lines: DataFrame, folder: str, *order: str) -> None:
    """Column ``line`` as text files whose names and lines follow ``order``."""
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.mode("overwrite").text(folder)
