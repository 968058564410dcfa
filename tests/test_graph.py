import heapq
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import centrality, cooc, graph, paths
from wordloom.operators import communities as louvain
from wordloom.operators.blocks import BlockGraph
from wordloom.operators.communities import communities
from wordloom.plans.keyword_graph import keyword_graph
from wordloom.session import checkpoint

SCHEMA = "src string, dst string, weight long"


def random_edges(nodes, share, seed, top=9):
    rng = random.Random(seed)
    pairs = itertools.combinations([f"n{i:03}" for i in range(nodes)], 2)
    return [(a, b, rng.randint(1, top)) for a, b in pairs if rng.random() < share]


def neighbours(edges, weight=lambda w: w):
    graph_ = {}
    for a, b, w in edges:
        graph_.setdefault(a, {})[b] = weight(w)
        graph_.setdefault(b, {})[a] = weight(w)
    return graph_


def single_source(links, source):
    """Distances, numbers of shortest paths, predecessors and settling order."""
    dist, count, before, order = {source: 0}, {source: 1}, {source: []}, []
    heap, done = [(0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, w in links[v].items():
            new = d + w
            if u not in dist or new < dist[u]:
                dist[u], count[u], before[u] = new, count[v], [v]
                heapq.heappush(heap, (new, u))
            elif new == dist[u] and u not in done:
                count[u] += count[v]
                before[u].append(v)
    return dist, count, before, order


def scores(df):
    return {row["term"]: row["score"] for row in df.collect()}


@pytest.mark.parametrize("name,expected", [
    ("weighted_degree", [5, 3, 3, 1]),
    ("closeness", [1.5, 1.0, 1.0, 0.75]),
    ("betweenness", [2 / 3, 0, 0, 0]),
    ("betwenness", [2 / 3, 0, 0, 0]),
    ("pagerank", [0.404868, 0.244402, 0.244402, 0.106327]),
    ("eigenvector", [0.649827, 0.521121, 0.521121, 0.185986]),
])
def test_goldens(fruit_edges, name, expected):
    found = scores(graph.centrality_by(fruit_edges, name))
    assert found == pytest.approx(dict(zip(["apple", "banana", "cherry", "durian"], expected)), abs=1e-5)


def test_dispatch(fruit_edges):
    assert graph.centrality_by(fruit_edges, "frequency") is None
    with pytest.raises(ValueError):
        graph.centrality_by(fruit_edges, "degree")


@pytest.mark.parametrize("nodes,share", [(12, 0.25), (290, 0.02), (1100, 0.003)])
def test_path_measures_equal_brute_force(spark, nodes, share, monkeypatch):
    """Small with several parts, several batches, and several ranges of nodes and waves of sources."""
    monkeypatch.setattr(paths, "WAVE", 7)
    rows = random_edges(nodes, share, seed=nodes)
    edges = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = neighbours(rows)
    through = dict.fromkeys(links, 0.0)
    for source in links:
        _, count, before, order = single_source(links, source)
        carried = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                carried[v] += count[v] / count[w] * (1 + carried[w])
            if w != source:
                through[w] += carried[w]
    n = len(links)
    assert scores(centrality.betweenness(edges)) == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in through.items()}, abs=1e-9)

    inverse = neighbours(rows, lambda w: 1 / w)
    expected = {}
    for source in inverse:
        dist = single_source(inverse, source)[0]
        reached = len(dist) - 1
        expected[source] = reached / sum(dist.values()) * reached / (n - 1)
    assert scores(centrality.closeness(edges)) == pytest.approx(expected, abs=1e-9)

    found = {(r["src"], r["dst"]): r["dist"] for r in paths.distance_pairs(BlockGraph(edges)).collect()}
    whole = {(a, b): d for a in links for b, d in single_source(links, a)[0].items() if a < b}
    assert found == pytest.approx(whole)


def test_spectral_measures_equal_numpy(spark):
    rows = random_edges(290, 0.05, seed=3)
    edges = spark.createDataFrame(rows, SCHEMA)
    terms = sorted({t for row in rows for t in row[:2]})
    index = {t: i for i, t in enumerate(terms)}
    matrix = np.zeros((len(terms), len(terms)))
    for a, b, w in rows:
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = w
    leading = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    found = scores(centrality.eigenvector(edges))
    assert [found[t] for t in terms] == pytest.approx(leading, abs=1e-9)
    assert sum(x * x for x in found.values()) == pytest.approx(1)

    moves = matrix / matrix.sum(axis=1, keepdims=True)
    x = np.full(len(terms), 1 / len(terms))
    for _ in range(100):
        last, x = x, 0.85 * (x @ moves) + 0.15 / len(terms)
        if np.abs(x - last).sum() < len(terms) * 1e-6:
            break
    found = scores(centrality.pagerank(edges))
    assert [found[t] for t in terms] == pytest.approx(x, abs=1e-12)
    assert sum(found.values()) == pytest.approx(1)


def test_bipartite_eigenvector(spark):
    edges = spark.createDataFrame([("a", "b", 3)], SCHEMA)
    assert scores(centrality.eigenvector(edges)) == pytest.approx({"a": 0.5**0.5, "b": 0.5**0.5})


def test_no_edges(spark):
    edges = spark.createDataFrame([], SCHEMA)
    for name in ["weighted_degree", "closeness", "betweenness", "pagerank", "eigenvector"]:
        assert graph.centrality_by(edges, name).collect() == []
    assert communities(edges).collect() == []
    assert graph.scale_edges(edges).collect() == []


def test_edge_scaling(fruit_edges):
    rows = {(r["src"], r["dst"]): r for r in graph.scale_edges(fruit_edges).collect()}
    assert rows["apple", "banana"]["width"] == pytest.approx(1.2)
    assert {k: r["nor_weight"] for k, r in rows.items()} == {
        ("apple", "banana"): 1.0, ("apple", "cherry"): 1.0, ("apple", "durian"): 0.0, ("banana", "cherry"): 0.0,
    }


def test_width_is_that_of_numpy(spark):
    rows = random_edges(20, 0.8, seed=5, top=1000)
    weights = np.array([w for *_, w in rows], dtype=float)
    scaled = (weights - weights.min()) / (np.percentile(weights, 75) - weights.min() + 1e-9) + 0.2
    relative = (scaled - scaled.min()) / (scaled.max() - scaled.min())
    found = {(r["src"], r["dst"]): (r["width"], r["nor_weight"]) for r in graph.scale_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[a, b] for a, b, _ in rows] == list(zip(scaled, relative))


@pytest.mark.parametrize("part", [0.0, 0.1, 0.5, 0.75, 0.999, 1.0])
def test_percentiles_are_those_of_numpy(spark, part):
    rng = random.Random(3)
    for size in (1, 2, 7, 400):
        weights = [rng.choice([1, 2, 3, 50, rng.randint(1, 10**9)]) for _ in range(size)]
        edges = spark.createDataFrame([("a", "b", w) for w in weights], SCHEMA).repartition(6)
        assert graph.weight_percentile(edges, part).first()[0] == pytest.approx(np.percentile(weights, 100 * part))


def test_equal_weights_keep_no_edge(spark):
    edges = spark.createDataFrame([("a", "b", 4), ("b", "c", 4)], SCHEMA)
    scaled = graph.scale_edges(edges)
    assert {r["nor_weight"] for r in scaled.collect()} == {None}
    assert graph.threshold_edges(scaled, 0.0).collect() == []


def test_top_terms_and_subgraph(fruit_edges):
    top = graph.top_terms(centrality.weighted_degree(fruit_edges), 2)
    assert [r["term"] for r in top.collect()] == ["apple", "banana"]
    assert [tuple(r) for r in graph.subgraph(fruit_edges, top).collect()] == [("apple", "banana", 2)]


def cliques(spark):
    rows = [(f"{c}{i}", f"{c}{j}", 10) for c in "ab" for i, j in itertools.combinations(range(5), 2)]
    return spark.createDataFrame(rows + [("a0", "b0", 1)], SCHEMA)


def test_planted_communities(spark):
    for parts in (1, 5):
        found = {r["term"]: r["group"] for r in communities(cliques(spark).repartition(parts)).collect()}
        assert found == {f"{c}{i}": "ab".index(c) for c in "ab" for i in range(5)}


def test_hub_does_not_stall(spark):
    edges = spark.createDataFrame([("hub", f"leaf{i:02}", 1) for i in range(40)], SCHEMA)
    found = communities(edges)
    assert found.count() == 41
    assert graph.modularity(edges, found).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_moves_of_a_round_gain_together(spark):
    """Every round raises modularity, whatever is moved at once; nodes crowd into few communities."""
    rng = random.Random(6)
    rows = random_edges(60, 0.2, seed=21) + [("n000", f"x{i:02}", rng.randint(1, 3)) for i in range(60)]
    edges = spark.createDataFrame(rows, SCHEMA)
    links = centrality.both_ways(edges).selectExpr("src as a", "dst as b", "weight")
    twice_m = float(2 * sum(w for *_, w in rows))
    place = links.groupBy("a").agg(F.sum("weight").cast("double").alias("degree")).selectExpr("a as node", "a as community", "degree", "degree as total")
    last = -1.0
    for _ in range(4):
        place = checkpoint(place)
        value = graph.modularity(edges, place.selectExpr("node as term", "xxhash64(community) as `group`")).first()[0]
        assert value > last
        last = value
        gains = checkpoint(louvain._gains(links, place, twice_m))
        if gains.isEmpty():
            break
        moves = louvain._safe_moves(gains, twice_m)
        after = place.join(moves, "node", "left").selectExpr("node", "coalesce(target, community) as community", "degree")
        place = after.join(after.groupBy("community").agg(F.sum("degree").alias("total")), "community").select("node", "community", "degree", "total")


def test_no_two_communities_gain_by_merging(spark):
    rows = random_edges(50, 0.15, seed=12)
    found = communities(spark.createDataFrame(rows, SCHEMA))
    group = {r["term"]: r["group"] for r in found.collect()}
    links, m2 = neighbours(rows), 2 * sum(w for *_, w in rows)
    assert set(group) == set(links)
    firsts = [min(t for t in group if group[t] == g) for g in range(len(set(group.values())))]
    assert firsts == sorted(firsts)
    total, between = dict.fromkeys(group.values(), 0), {}
    for v in links:
        total[group[v]] += sum(links[v].values())
    for a, b, w in rows:
        if group[a] != group[b]:
            pair = tuple(sorted((group[a], group[b])))
            between[pair] = between.get(pair, 0) + w
    assert all(w / m2 - total[g] * total[h] / m2**2 < 1e-6 for (g, h), w in between.items())


def test_rounds_use_no_window(spark):
    links = centrality.both_ways(cliques(spark)).selectExpr("src as a", "dst as b", "weight")
    place = links.groupBy("a").agg(F.sum("weight").cast("double").alias("degree")).selectExpr("a as node", "a as community", "degree", "degree as total")
    moves = louvain._safe_moves(louvain._gains(links, place, 82.0), 82.0)
    assert "Window" not in spark._jvm.PythonSQLUtils.explainString(moves._jdf.queryExecution(), "simple")


def test_communities_beat_parts_and_singletons(spark):
    edges = spark.createDataFrame(random_edges(40, 0.12, seed=11), SCHEMA)
    found = communities(edges)
    whole = found.selectExpr("term", "0L as `group`")
    singles = found.selectExpr("term", "xxhash64(term) as `group`")
    best = graph.modularity(edges, found).first()[0]
    assert best > 0.2
    assert best >= graph.modularity(edges, whole).first()[0]
    assert best >= graph.modularity(edges, singles).first()[0]


def test_keyword_graph_golden(fruit):
    result = keyword_graph(fruit)
    assert {r["term"] for r in result.nodes.collect()} == {"apple", "banana", "cherry", "durian"}
    assert result.edges.count() == 4
    kept = {r["term"]: (r["weight"], r["group"]) for r in result.kept_nodes.collect()}
    assert kept == {"apple": (1.0, 0), "banana": (0.2, 0), "cherry": (0.8, 0)}
    assert sorted((r["src"], r["dst"], r["group"]) for r in result.kept_edges.collect()) == [
        ("apple", "banana", 0), ("apple", "cherry", 0),
    ]
    parsed = json.loads(graph.node_link_json(result.kept_nodes, result.kept_edges).first()["json"])
    assert parsed["directed"] is False and parsed["graph"] == {}
    assert [n["id"] for n in parsed["nodes"]] == ["apple", "banana", "cherry"]
    assert len(parsed["links"]) == 2


def test_frequency_keeps_every_term(fruit):
    assert keyword_graph(fruit, sort_by="frequency", top_n=1).nodes.count() == 4
    assert keyword_graph(fruit, sort_by="weighted_degree", top_n=2).nodes.count() == 2


def test_empty_corpus_gives_empty_graph(fruit):
    result = keyword_graph(fruit.where("doc_id < 0"))
    for table, columns in [
        (result.nodes, {"term", "weight"}), (result.edges, {"src", "dst", "weight", "nor_weight"}),
        (result.kept_nodes, {"term", "weight", "group"}),
        (result.kept_edges, {"src", "dst", "weight", "nor_weight", "group"}),
    ]:
        assert table.collect() == [] and set(table.columns) == columns


def test_isolated(fruit_edges):
    assert {r["term"] for r in cooc.endpoints(fruit_edges).collect()} == {"apple", "banana", "cherry", "durian"}


def test_ritz_vector_of_plain_matrices():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 9):
        matrix = rng.random((size, size))
        matrix = matrix + matrix.T
        columns = [np.ones(size)]
        for _ in range(centrality.EIGEN_BASIS):
            columns.append(matrix @ columns[-1])
        columns = np.array(columns).T
        weights, _, turned = centrality.ritz_vector(np.linalg.qr(np.vstack([columns, np.zeros((9, 7))]), mode="r"))
        found = columns[:, : len(weights)] @ weights
        leading = np.linalg.eigh(matrix)[1][:, -1]
        assert abs(abs(found @ leading) - 1) < (1e-9 if size < 4 else 1e-4)
        assert turned < (1e-8 if size < 4 else 0.1)


@pytest.mark.parametrize("name", ["pagerank", "eigenvector"])
def test_spectral_measures_over_several_ranges(spark, name):
    """More nodes than a range holds, in two parts of which one has the larger eigenvalue."""
    rows = random_edges(1100, 0.01, seed=8) + [("z1", "z2", 3), ("z2", "z3", 4)]
    found = scores(graph.centrality_by(spark.createDataFrame(rows, SCHEMA).repartition(5), name))
    terms = sorted({t for row in rows for t in row[:2]})
    index = {t: i for i, t in enumerate(terms)}
    matrix = np.zeros((len(terms), len(terms)))
    for a, b, w in rows:
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = w
    if name == "eigenvector":
        expected = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    else:
        expected = np.full(len(terms), 1 / len(terms))
        for _ in range(100):
            last, expected = expected, 0.85 * (expected @ (matrix / matrix.sum(axis=1, keepdims=True))) + 0.15 / len(terms)
            if np.abs(expected - last).sum() < len(terms) * 1e-6:
                break
    assert [found[t] for t in terms] == pytest.approx(expected, abs=1e-9)
