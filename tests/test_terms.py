import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.operators import cooc, terms
from wordloom.session import checkpoint

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(30)], k=rng.randint(0, 60))) for _ in range(80)]
    return texts + ["", "x", "w1 " * 5000]


@pytest.fixture(scope="module")
def random_docs(spark, random_texts):
    return spark.createDataFrame(list(enumerate(random_texts)), "doc_id long, text string").repartition(5)


def counts_of(texts):
    return [Counter(t for t in text.split() if len(t) > 1) for text in texts]


def as_dict(df, value):
    return {row["term"]: row[value] for row in df.collect()}


def test_tfidf_golden(fruit):
    scores = as_dict(terms.tfidf_table(fruit), "score")
    assert scores == pytest.approx(
        {"apple": 1.764063, "banana": 1.232570, "cherry": 1.634044, "durian": 0.842926}, abs=1e-6
    )


def test_tfidf_json(fruit):
    table = terms.tfidf_table(fruit)
    parsed = json.loads(terms.tfidf_json(table).first()["json"])
    assert list(parsed["TF-IDF"]) == ["apple", "cherry", "banana", "durian"]


def test_tfidf_equals_brute_force(random_docs, random_texts):
    counts = counts_of(random_texts)
    df = Counter(term for count in counts for term in count)
    idf = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in df.items()}
    expected = Counter()
    for count in counts:
        norm = math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in count.items()))
        for term, tf in count.items():
            expected[term] += tf * idf[term] / norm
    assert as_dict(terms.tfidf_table(random_docs), "score") == pytest.approx(dict(expected), abs=1e-9)


def test_common_and_rare_terms_meet(random_docs, monkeypatch):
    """Splitting common terms off the join changes nothing."""
    whole = as_dict(terms.tfidf_table(random_docs), "score")
    monkeypatch.setattr(terms, "COMMON_SHARE", 0.05)
    assert as_dict(terms.tfidf_table(random_docs), "score") == pytest.approx(whole, abs=1e-12)


def test_vocabulary(random_docs, random_texts):
    counts = counts_of(random_texts)
    df = Counter(term for count in counts for term in count)
    cf = sum(counts, Counter())
    frequent = sorted((t for t in df if df[t] >= 0.3 * len(counts)), key=lambda t: (-cf[t], t))[:6]
    vocab = terms.vocab_index(terms.vocab_pruned(random_docs, 0.3, 6))
    found = {row["term"]: (row["idx"], row["df"], row["cf"]) for row in vocab.collect()}
    assert found == {t: (sorted(frequent).index(t), df[t], cf[t]) for t in frequent}


def test_vocabulary_cap(fruit):
    with pytest.raises(ValueError):
        terms.vocab_pruned(fruit, max_features=0)
    assert terms.vocab_pruned(fruit, max_features=1_000_000).count() == 4


def test_vocabulary_of_several_tiles(spark, monkeypatch):
    """More terms than the former ceiling, more tiles than a task holds."""
    monkeypatch.setattr(cooc, "TASK_TILES", 3)
    words = [f"w{i:05d}" for i in range(4500)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4500, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = terms.vocab_pruned(docs, min_df=0.0, max_features=5000)
    found = {(r["src"], r["dst"]): r["weight"] for r in cooc.cooccurrence(docs, vocab).collect()}
    expected = Counter()
    for text in texts:
        listed = text.split()
        for i, a in enumerate(listed):
            for b in listed[i:]:
                expected[a, b] += 1
    assert found == expected


@pytest.mark.parametrize("binary", [False, True])
def test_cooccurrence_equals_brute_force(random_docs, random_texts, binary, monkeypatch):
    monkeypatch.setattr(cooc, "BLOCK_DOCS", 7)
    counts = [Counter({t: 1 for t in c}) if binary else c for c in counts_of(random_texts)]
    expected = Counter()
    for count in counts:
        for a in count:
            for b in count:
                if a <= b and a != "x":
                    expected[a, b] += count[a] * count[b]
    cells = cooc.cooccurrence(random_docs, terms.vocab_pruned(random_docs), binary)
    found = {(r["src"], r["dst"]): r["weight"] for r in cells.collect()}
    assert found == {pair: n for pair, n in expected.items() if n}


def test_cooccurrence_of_twenty_thousand_terms(spark, monkeypatch):
    """Texts with words from all over the vocabulary; postings are multiplied in several portions."""
    monkeypatch.setattr(cooc, "TASK_POSTINGS", 8_000)
    words = [f"w{i:05d}" for i in range(20_000)]
    rng = random.Random(5)
    texts = [" ".join(words[i : i + 500] + rng.choices(words, k=60)) for i in range(0, 20_000, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    vocab = terms.vocab_pruned(docs, min_df=0.0, max_features=20_000)
    assert vocab.count() == 20_000
    expected = Counter()
    for text in texts:
        counts = Counter(text.split())
        listed = sorted(counts)
        for i, a in enumerate(listed):
            for b in listed[i:]:
                expected[a, b] += counts[a] * counts[b]
    cells = cooc.cooccurrence(docs, vocab)
    sample = cells.where("src < 'w00700'").collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in sample} == {p: n for p, n in expected.items() if p[0] < "w00700"}
    assert cells.agg(F.count("*"), F.sum("weight")).first() == (len(expected), expected.total())


@pytest.mark.parametrize("tiles,postings", [(100, 1 << 22), (2, 1 << 22), (2, 300)])
def test_tiles_held_whole_and_in_portions(monkeypatch, tiles, postings):
    """The tasks' own work: all tiles at once, or one after the other for some postings at a time."""
    monkeypatch.setattr(cooc, "TILE_TERMS", 8)
    monkeypatch.setattr(cooc, "BLOCK_DOCS", 7)
    monkeypatch.setattr(cooc, "TASK_TILES", tiles)
    monkeypatch.setattr(cooc, "TASK_POSTINGS", postings)
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 5, (90, 30)) * (rng.random((90, 30)) < 0.3)
    lists = [[{"term": f"t{j:02}", "tf": int(row[j])} for j in np.flatnonzero(row)] + [{"term": "other", "tf": 1}] for row in counts]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    batches = [pa.RecordBatch.from_arrays([pa.array([*lists[i : i + 20], None], kind)], names=["terms"]) for i in range(0, 90, 20)]
    known = pa.array([f"t{j:02}" for j in range(30)])
    for binary, expected in ((False, counts), (True, (counts > 0).astype(int))):
        total, seen = np.zeros((32, 32), int), 0
        for row, column, tile in cooc.tile_products(cooc.known_postings(iter(batches), known, binary), 4):
            total[row * 8 : row * 8 + 8, column * 8 : column * 8 + 8] += tile
            seen += 1
        assert (np.triu(total)[:30, :30] == np.triu(expected.T @ expected)).all()
        assert seen == 10 if postings > 300 else seen > 10


def test_few_tiles_take_postings_as_they_come(monkeypatch):
    """What a task holds does not grow with its documents: a part of a batch is passed on before the next is looked up."""
    monkeypatch.setattr(cooc, "LOOKUP_DOCS", 14, raising=False)
    monkeypatch.setattr(cooc, "BLOCK_DOCS", 7)
    monkeypatch.setattr(cooc, "TILE_TERMS", 8)
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 5, (90, 30)) * (rng.random((90, 30)) < 0.3)
    lists = [[{"term": f"t{j:02}", "tf": int(row[j])} for j in np.flatnonzero(row)] for row in counts]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    read = []

    def batches():
        for i in range(0, 90, 45):
            read.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(lists[i : i + 45], kind)], names=["terms"])

    known = pa.array([f"t{j:02}" for j in range(30)])
    seen = []
    for some in cooc.known_postings(batches(), known, False, 1):
        seen.append((len(read), len(np.unique(some.rows))))
        assert some.rows.itemsize <= 4 and some.counts.itemsize <= 4
    assert [n for n, _ in seen] == [1, 1, 1, 1, 2, 2, 2, 2] and max(docs for _, docs in seen) <= 14
    total = np.zeros((32, 32), int)
    for row, column, tile in cooc.tile_products(cooc.known_postings(batches(), known, False, 1), 4):
        total[row * 8 : row * 8 + 8, column * 8 : column * 8 + 8] += tile
    assert (np.triu(total)[:30, :30] == np.triu(counts.T @ counts)).all()


def test_common_terms_travel_as_numbers(spark, monkeypatch):
    """A common posting is two numbers on its way to the norm, and a batch is weighed by parts."""
    monkeypatch.setattr(terms, "WEIGHED_DOCS", 2, raising=False)
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb"), (3, ""), (4, "dd aa"), (5, None)], "doc_id long, text string").coalesce(1)
    rows = terms.weighed_rows(terms.counted(docs), {"aa": 2.0, "bb": 0.5})
    assert "string" not in rows.select("numbers", "counts").schema.simpleString()
    found = {r["doc_id"]: (r["numbers"], r["counts"], r["common_square"], [tuple(t) for t in r["rare"]]) for r in rows.collect()}
    assert found == {
        1: ([0, 1], [2, 1], 16.25, [("cc", 1)]),
        2: ([1], [1], 0.25, []),
        3: ([], [], 0.0, []),
        4: ([0], [1], 4.0, [("dd", 1)]),
        5: ([], [], 0.0, []),
    }


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_cells_become_rows_after_their_sums(fruit):
    plan = plan_of(cooc.cooccurrence(fruit, terms.vocab_pruned(fruit)))
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    tiles = [d for d in dealt if d.startswith("row#")]
    assert len(tiles) == 2 and all("places#" in d for d in tiles)
    assert not any("weight#" in d and "i#" in d and d.startswith("i#") for d in dealt[: dealt.index(tiles[-1])])


def test_packed_tiles(monkeypatch):
    monkeypatch.setattr(cooc, "TILE_TERMS", 4)
    rng = np.random.default_rng(1)
    for held in (0, 0.2, 0.9):
        for top in (5, 1 << 40):
            tile = rng.integers(1, top, (4, 4)) * (rng.random((4, 4)) < held)
            total = np.arange(16)
            cooc.add_packed(total, *cooc.packed(tile))
            assert (total == np.arange(16) + tile.ravel()).all()


@pytest.mark.parametrize("share", [1e-4, 0.2, 1.0])
def test_tfidf_of_common_and_rare_terms(random_docs, random_texts, share, monkeypatch):
    """All terms common, some, or none: the same weights."""
    monkeypatch.setattr(terms, "COMMON_SHARE", share)
    counts = counts_of(random_texts)
    df = Counter(t for c in counts for t in c)
    expected = {}
    for doc_id, count in enumerate(counts):
        weights = {t: n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in count.items() if len(t) > 1}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        expected |= {(doc_id, t): w / norm for t, w in weights.items()}
    weights = terms.doc_tfidf(random_docs)
    found = {(r["doc_id"], r["term"]): r["tfidf"] for r in weights.collect()}
    assert found == pytest.approx(expected)
    plan = plan_of(weights)
    assert "Window" not in plan
    assert terms.doc_tfidf(terms.counted_documents(random_docs)).count() == len(expected)


def test_cooccurrence_of_large_counts_is_exact(spark, monkeypatch):
    monkeypatch.setattr(cooc, "EXACT_DOUBLE", 4.0)
    docs = spark.createDataFrame([(1, "aa aa aa bb bb")], "doc_id long, text string")
    cells = cooc.cooccurrence(docs, terms.vocab_pruned(docs))
    assert {(r["src"], r["dst"]): r["weight"] for r in cells.collect()} == {
        ("aa", "aa"): 9, ("aa", "bb"): 6, ("bb", "bb"): 4,
    }


def test_node_weights_and_edges(fruit):
    cells = checkpoint(cooc.cooccurrence(fruit, terms.vocab_pruned(fruit)))
    nodes = cooc.node_weights(cells)
    assert as_dict(nodes, "strength") == {"apple": 6, "banana": 2, "cherry": 5, "durian": 1}
    assert as_dict(nodes, "weight") == {"apple": 1.0, "banana": 0.2, "cherry": 0.8, "durian": 0.0}
    assert cooc.edges_above(cells).count() == 4
    assert cooc.edges_above(cells, 1).count() == 2
    left = cooc.drop_isolated(nodes, cooc.edges_above(cells, 1))
    assert {row["term"] for row in left.collect()} == {"apple", "banana", "cherry"}


def test_single_document_is_split(spark, fruit):
    single = spark.createDataFrame([(9, "a b c d e")], "doc_id long, text string")
    rows = terms.split_single_document(single).orderBy("doc_id").collect()
    assert [tuple(row) for row in rows] == [(0, "a b"), (1, "c d e")]
    assert sorted(map(tuple, terms.split_single_document(fruit).collect())) == sorted(map(tuple, fruit.collect()))


def test_empty_corpus(fruit):
    empty = fruit.where("doc_id < 0")
    assert terms.tfidf_table(empty).collect() == []
    cells = cooc.cooccurrence(empty, terms.vocab_pruned(empty))
    assert cells.collect() == [] and cells.columns == ["src", "dst", "weight"]


def test_stop_words(spark, fruit):
    postings = terms.term_frequency(fruit)
    by_list = terms.drop_stop_words(postings, ["apple", "cherry"])
    table = spark.createDataFrame([("apple",), ("cherry",)], "word string")
    expected = sorted([(1, "banana", 1), (2, "banana", 1), (4, "durian", 1)])
    assert sorted(map(tuple, by_list.collect())) == expected
    assert sorted(map(tuple, terms.drop_stop_words(postings, table).collect())) == expected


def test_dictionary(spark):
    dictionary = spark.createDataFrame([(w,) for w in ["cat", "cats", "fact", "facts"]], "word string")
    words = spark.createDataFrame([(w,) for w in ["cat", "ca", "facts", "factss", "", "cat"]], "word string")
    found = {row["word"]: row["found"] for row in terms.lookup_words(words, dictionary).collect()}
    assert found == {"cat": True, "ca": False, "facts": True, "factss": False, "": False}
    assert {row["word"] for row in terms.unknown_words(words, dictionary).collect()} == {"ca", "factss", ""}


def test_no_term_is_counted_twice_in_the_plan(fruit):
    """The tokens of a document are worked out once, not again for a filter below."""
    plan = terms.vocab_stats(fruit)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("ids", [["abc"], ["abc", "x1"]])
def test_string_ids(spark, ids):
    docs = spark.createDataFrame([(i, "a b c d e") for i in ids], "doc_id string, text string")
    split = terms.split_single_document(docs)
    assert dict(split.dtypes)["doc_id"] == "string"
    expected = ["0", "1"] if len(ids) == 1 else ids
    assert sorted(r["doc_id"] for r in split.collect()) == expected
