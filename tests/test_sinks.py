"""What is written can be read again."""

import json

from pyspark.sql import functions as F

from wordloom.operators import graph, terms
from wordloom.operators.cooc import endpoints
from wordloom.sources.tables import write_graph, write_json_text, write_lines


def test_graph_tables(spark, fruit_edges, tmp_path):
    nodes = endpoints(fruit_edges)
    write_graph(nodes, fruit_edges, str(tmp_path / "g"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "g/edges")).collect())) == sorted(map(tuple, fruit_edges.collect()))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 4


def test_json_text(spark, fruit, tmp_path):
    table = terms.tfidf_json(terms.tfidf_table(fruit))
    write_json_text(table, str(tmp_path / "t"))
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert list(json.loads(line)["TF-IDF"]) == ["apple", "cherry", "banana", "durian"]


def test_lines_are_one_document(spark, fruit_edges, tmp_path):
    edges = graph.scale_edges(fruit_edges)
    groups = endpoints(fruit_edges).withColumn("group", F.lit(0))
    lines = graph.node_link_lines(groups.withColumn("weight", F.lit(1.5)), graph.group_edges(edges, groups))
    write_lines(lines, str(tmp_path / "l"), "part", "first", "second")
    files = sorted((tmp_path / "l").glob("part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert [n["id"] for n in whole["nodes"]] == ["apple", "banana", "cherry", "durian"]
    assert [(x["source"], x["target"]) for x in whole["links"]] == [("apple", "banana"), ("apple", "cherry"), ("apple", "durian"), ("banana", "cherry")]
