"""Landed pages to articles, and rankings to details, as one plan each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators import articles as art
from wordloom.operators.extract import (
    ARTICLE_RULES,
    REQUIRED_FIELDS,
    Rule,
    complete_articles,
    extract_articles,
    extract_ranking,
    rejected_articles,
)
from wordloom.operators.search_index import SearchIndex, build_index

SEARCHED = ["articleTitle", "article"]


@dataclass(frozen=True)
class Articles:
    """What landed pages hold: one row for each address, and the pages that lack a field."""

    articles: DataFrame
    rejects: DataFrame


def landed_articles(
    *landed: DataFrame, rules: Mapping[str, Rule] = ARTICLE_RULES, required: Sequence[str] = REQUIRED_FIELDS
) -> Articles:
    """Articles of all landed tables ``(url, html)``; of pages with the same address the earliest dated stays."""
    extracted = art.union_articles(*[extract_articles(pages, rules) for pages in landed])
    complete = complete_articles(extracted, required)
    return Articles(art.dedup_first(complete, ["url"], ["pub_date"]), rejected_articles(extracted, required))


def search_articles(
    found: Articles,
    word: str | None,
    start: date | str | None = None,
    end: date | str | None = None,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Articles with ``word`` in the title or the body, dated within the days, newest first."""
    return art.search(found.articles, word, SEARCHED, F.col("pub_date"), start, end, index=index)


def article_index(found: Articles) -> SearchIndex:
    """An index for many searches among the same articles."""
    return build_index(found.articles, "url", SEARCHED)


def week_ranking(
    events: DataFrame, moment: Column, discussed: Column, section: str, item: str, as_of: date | str | None = None
) -> DataFrame:
    """Most viewed and most discussed items of each day, of the week that ends with ``as_of`` if it is given."""
    day = moment.cast("date")
    seen = events if as_of is None else art.within_week(events, moment, as_of)
    viewed = art.daily_ranking(seen, day, section, item, "popular_day")
    return viewed.unionByName(art.daily_ranking(seen.where(discussed), day, section, item, "popular_memo"))


def week_details(ranking: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Ranked items with their details."""
    return art.ranking_detail(ranking, details, "item", key, keep_rank_columns=True)


def landed_week_details(rankings: DataFrame, details: Articles, as_of: date | str, base_url: str, **where: object) -> DataFrame:
    """Landed ranking pages ``(rank_date, ranking_type, html)`` of the week that ends with ``as_of``, and their articles.

    Each ranked link brings its article's columns; links whose page did not land are left out.
    """
    ranked = extract_ranking(art.within_week(rankings, F.col("rank_date"), as_of), base_url, **where)
    return art.ranking_detail(ranked, details.articles, "href", "url", keep_rank_columns=True)
