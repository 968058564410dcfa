"""Search, de-duplication, joins and rankings over article, comment and event tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.constants import RANKING_DEPTH
from wordloom.operators.joins import join_detail
from wordloom.operators.search_index import SearchIndex, rows_with


def search(
    table: DataFrame,
    query: str | None,
    text_columns: Sequence[str],
    day: Column | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    tie: Sequence[str] = ("url",),
    index: SearchIndex | None = None,
) -> DataFrame:
    """Rows that hold ``query`` in one of the text columns, dated within the days.

    With an ``index`` of the table over the same columns only rows that it lists are looked
    at. Both days count. Newest first, then by ``tie``. ``day`` may be a date or a
    timestamp column; the range is written on the column itself so that it reaches
    the scan.
    """
    found = table
    if index is not None and tuple(text_columns) != index.columns:
        raise ValueError("the index is over other columns")
    if query is not None and index is not None:
        found = rows_with(table, index, query)
    elif query is not None:
        hit = F.lit(False)
        for name in text_columns:
            hit = hit | F.coalesce(F.contains(F.col(name), F.lit(query)), F.lit(False))
        found = found.where(hit)
    if day is None:
        return found.orderBy(*tie)
    if start is not None:
        found = found.where(day >= F.lit(str(start)).cast("date"))
    if end is not None:
        found = found.where(day < F.date_add(F.lit(str(end)).cast("date"), 1))
    return found.orderBy(day.desc(), *tie)


def union_articles(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns a table lacks, such as the section, are null."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def dedup_first(table: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each key; nulls come last, ties go by the rest of the row.

    An aggregate, not a window: every task reduces its own copies of a key to one row
    before the shuffle, so a key with very many copies does no harm.
    """
    others = [name for name in table.columns if name not in keys]
    columns = [column for name in order for column in (F.isnull(name), F.col(name))]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    ranked = F.struct(*[column.alias(f"o{i}") for i, column in enumerate([*columns, tie])])
    kept = table.groupBy(*keys).agg(F.min_by(F.struct(*others), ranked).alias("first"))
    return kept.select(*[F.col(name) if name in keys else F.col("first")[name].alias(name) for name in table.columns])


def article_comments(articles: DataFrame, comments: DataFrame, on: str = "url") -> DataFrame:
    """Comments with their article's columns; articles without comments give no row."""
    joined = join_detail(comments, articles, on)
    return joined.select(*articles.columns, *[name for name in comments.columns if name != on])


def top_level(comments: DataFrame, parent: str = "parentId") -> DataFrame:
    """Comments that answer no other comment."""
    return comments.where(F.col(parent) == 0)


def by_favour(
    comments: DataFrame, favour: str, tie: Sequence[str], per: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Comments by falling favour; with ``limit``, the first so many of each ``per``."""
    order = [F.desc(favour), *[F.col(name) for name in tie]]
    if limit is None:
        return comments.orderBy(*[F.col(name) for name in per], *order)
    ranked = comments.withColumn("position", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.where(F.col("position") <= limit)


def daily_ranking(
    events: DataFrame,
    day: Column,
    section: str,
    item: str,
    ranking_type: str,
    depth: int = RANKING_DEPTH,
) -> DataFrame:
    """The most counted items of each day and section.

    ``(rank_date, ranking_type, section, position, item, n)``. Counting is aggregated
    before its shuffle, and Spark cuts each task's rows to ``depth`` a group before the
    window's.
    """
    counts = events.groupBy(day.cast("date").alias("rank_date"), F.col(section).alias("section"), F.col(item).alias("item")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = Window.partitionBy("rank_date", "section").orderBy(F.desc("n"), "item")
    ranked = counts.withColumn("position", F.row_number().over(best)).where(F.col("position") <= depth)
    return ranked.select("rank_date", F.lit(ranking_type).alias("ranking_type"), "section", "position", "item", "n")


def week_days(as_of: DataFrame) -> DataFrame:
    """The seven days that end with each ``as_of`` day: ``(as_of, day)``."""
    return as_of.select("as_of", F.explode(F.sequence(F.date_sub("as_of", 6), F.col("as_of"))).alias("day"))


def within_week(table: DataFrame, moment: Column, as_of: date | str) -> DataFrame:
    """Rows of the seven days that end with ``as_of``, as a range the scan can use."""
    last = F.lit(str(as_of)).cast("date")
    return table.where((moment >= F.date_sub(last, 6)) & (moment < F.date_add(last, 1)))


def ranking_detail(
    ranking: DataFrame, details: DataFrame, link: str, key: str, keep_rank_columns: bool = False
) -> DataFrame:
    """Detail rows of the ranked links, once per ranked link.

    The ranking is short, a few rows a day and section, so Spark broadcasts it by size.
    """
    joined = ranking.join(details, ranking[link] == details[key])
    kept = [ranking[name] for name in ranking.columns] if keep_rank_columns else []
    return joined.select(*kept, *[details[name] for name in details.columns])
