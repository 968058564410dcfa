import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import articles as art
from wordloom.operators import search_index as si


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab가나 .\n", k=rng.randint(0, 30))), rng.choice([None, "", "ab나", "😀b😀"])) for i in range(300)]
    return rows + [(300, None, None), (301, "x" * 50_000 + "ab가" * 20_000, "long")]


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame(texts, "id long, title string, body string").repartition(5)


@pytest.mark.parametrize("gram", [1, 2, 3])
def test_search_equals_contains(table, texts, gram):
    index = si.build_index(table, "id", ["title", "body"], gram)
    for word in ["", "a", "ab", "가나", "b\na", "aab가", "xxxxxxxxxxxx", "나.", "😀b", "zz", "long", "ab가ab가ab가ab가x"]:
        expected = sorted(i for i, *cells in texts if any(c is not None and word in c for c in cells))
        found = art.search(table, word, ["title", "body"], tie=["id"], index=index)
        assert [r["id"] for r in found.collect()] == expected


def test_lists_hold_a_row_once_and_are_in_order(table):
    index = si.build_index(table, "id", ["title", "body"])
    assert index.lists.count() == index.lists.distinct().count() == index.sizes.agg(F.sum("n")).first()[0]
    plan = si.candidates(index, "ab가")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(" in plan or "In(gram" in plan


def test_no_task_sorts_more_lists_when_there_are_more(table, monkeypatch):
    monkeypatch.setattr(si, "LIST_ROWS", 200, raising=False)
    lists = si.build_index(table, "id", ["title", "body"]).lists
    sorted_by_one = [r["count"] for r in lists.groupBy(F.input_file_name()).count().collect()]
    assert sum(sorted_by_one) == lists.count() > 2_000
    assert max(sorted_by_one) <= 600


def test_wrong_use(table):
    with pytest.raises(ValueError):
        si.build_index(table, "id", ["title"], 0)
    index = si.build_index(table, "id", ["title"])
    with pytest.raises(ValueError):
        art.search(table, "ab", ["body"], tie=["id"], index=index)
    empty = table.where("false")
    assert art.search(empty, "ab", ["title"], tie=["id"], index=si.build_index(empty, "id", ["title"])).collect() == []
