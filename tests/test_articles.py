import datetime

import pytest
from pyspark.sql import functions as F

from wordloom.operators import articles as art
from wordloom.operators.joins import join_detail

DAY = datetime.date


def test_search(spark):
    rows = [("u1", "경제 뉴스", DAY(2019, 10, 1)), ("u2", "경제", DAY(2019, 10, 3)), ("u3", "정치", DAY(2019, 10, 2)),
            ("u0", "경제", DAY(2019, 10, 3)), ("u4", "경제", DAY(2019, 10, 4)), ("u5", None, DAY(2019, 10, 2))]
    table = spark.createDataFrame(rows, "url string, article string, day date")
    found = art.search(table, "경제", ["article"], F.col("day"), "2019-10-01", "2019-10-03")
    assert [r["url"] for r in found.collect()] == ["u0", "u2", "u1"]


def test_search_range_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = art.search(events, "click", ["event_type"], F.col("ts"), "2024-01-05", "2024-01-06", ["event_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_union_fills_missing_columns(spark):
    six = spark.createDataFrame([("u1", "c")], "url string, aclass string")
    five = spark.createDataFrame([("u2",)], "url string")
    assert sorted(map(tuple, art.union_articles(six, five, five).collect()), key=str) == [("u1", "c"), ("u2", None), ("u2", None)]


def test_dedup_keeps_the_first(spark):
    rows = [("u1", 2, "b"), ("u1", 1, "a"), ("u2", 3, None), ("u1", 1, "c")]
    table = spark.createDataFrame(rows, "url string, n int, t string").repartition(3)
    found = art.dedup_first(table, ["url"], ["n", "t"])
    assert found.columns == table.columns
    assert sorted(map(tuple, found.collect())) == [("u1", 1, "a"), ("u2", 3, None)]


def test_article_comments_inner(spark):
    articles = spark.createDataFrame([("u1", "A"), ("u2", "B"), ("u3", "C")], "url string, article string")
    comments = spark.createDataFrame([("u1", "x", 1), ("u1", "x", 1), ("u3", "y", 2), (None, "z", 3)], "url string, comment string, n int")
    found = art.article_comments(articles, comments)
    assert found.columns == ["url", "article", "comment", "n"]
    assert sorted(map(tuple, found.collect())) == [("u1", "A", "x", 1), ("u1", "A", "x", 1), ("u3", "C", "y", 2)]


@pytest.mark.parametrize("hot_share", [0.2, 1e-9, 2.0])
def test_hot_keys_change_nothing(spark, hot_share):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 5).alias("v")
    )
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    plain = many.join(one, "k").groupBy("k", "v", "d").count()
    found = join_detail(many, one, "k", hot_share).groupBy("k", "v", "d").count()
    assert sorted(map(tuple, found.select("k", "v", "d", "count").collect())) == sorted(map(tuple, plain.collect()))


def test_favour_and_top_level(spark):
    rows = [(1, 0, 5), (2, 0, 9), (3, 1, 9), (4, 0, None)]
    comments = spark.createDataFrame(rows, "id int, parentId int, likeCount int")
    assert [r["id"] for r in art.by_favour(art.top_level(comments), "likeCount", ["id"]).collect()] == [2, 1, 4]
    best = art.by_favour(comments, "likeCount", ["id"], per=["parentId"], limit=1)
    assert sorted(r["id"] for r in best.collect()) == [2, 3]


def test_daily_ranking(spark):
    rows = [("2019-10-03 01:00:00", "s", item) for item in [1, 1, 2, 2, 3]] + [("2019-10-04 01:00:00", "s", 9)]
    events = spark.createDataFrame(rows, "ts string, section string, item long").withColumn("ts", F.to_timestamp("ts"))
    found = art.daily_ranking(events, F.col("ts"), "section", "item", "popular_day", depth=2)
    assert sorted((str(r["rank_date"]), r["position"], r["item"], r["n"]) for r in found.collect()) == [
        ("2019-10-03", 1, 1, 2), ("2019-10-03", 2, 2, 2), ("2019-10-04", 1, 9, 1),
    ]


def test_ranking_is_cut_before_the_shuffle(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ranked = art.daily_ranking(events, F.col("ts"), "event_type", "user_id", "popular_day")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_week(spark):
    as_of = spark.createDataFrame([(DAY(2019, 10, 3),)], "as_of date")
    days = [r["day"] for r in art.week_days(as_of).orderBy("day").collect()]
    assert days == [DAY(2019, 9, 27) + datetime.timedelta(i) for i in range(7)]
    stamps = spark.createDataFrame([("2019-09-26 23:59:59",), ("2019-09-27 00:00:00",), ("2019-10-03 23:59:59",), ("2019-10-04 00:00:00",)], "t string")
    kept = art.within_week(stamps.select(F.to_timestamp("t").alias("t")), F.col("t"), "2019-10-03")
    assert kept.count() == 2


def test_ranking_detail_repeats_links(spark):
    ranking = spark.createDataFrame([("u1", 1), ("u1", 2), ("u9", 3)], "href string, position int")
    articles = spark.createDataFrame([("u1", "A"), ("u2", "B")], "url string, article string")
    assert [tuple(r) for r in art.ranking_detail(ranking, articles, "href", "url").collect()] == [("u1", "A")] * 2
    kept = art.ranking_detail(ranking, articles, "href", "url", keep_rank_columns=True)
    assert kept.columns == ["href", "position", "url", "article"]


def test_join_with_helper_names_and_maps(spark):
    many = spark.sql("select 1 as k, 2 as salt, true as hot, map('a', 1) as m union all select 1, 3, false, map('b', 2)")
    one = spark.sql("select 1 as k, 'x' as name")
    rows = join_detail(many, one, "k").select("k", "salt", "hot", "m", "name").collect()
    assert sorted((r["salt"], r["m"], r["name"]) for r in rows) == [(2, {"a": 1}, "x"), (3, {"b": 2}, "x")]


def test_dedup_keeps_rows_with_null_order(spark):
    table = spark.sql("select 'u1' as url, cast(null as int) as n, 'keep me' as text union all select 'u2', null, 'b' union all select 'u2', 5, 'a'")
    rows = art.dedup_first(table, ["url"], ["n"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("u1", None, "keep me"), ("u2", 5, "a")]
