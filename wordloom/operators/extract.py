"""Articles, links, rankings and comments out of landed pages and responses."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.constants import RANKING_DEPTH, RANKING_SECTION_IDS
from wordloom.functions.html import (
    Selector,
    decode_entities,
    element_markups,
    markup_text,
    section_anchors,
    visible_markup,
)
from wordloom.functions.text import normalise_body, parse_date


@dataclass(frozen=True)
class Rule:
    """Where a field stands and what becomes of its text; without a selector, of the page."""

    selector: Selector | None
    finish: Callable[[Column], Column] = lambda text: text


# Where the portal's article pages keep each field. The company is the first
# link of the first address.
ARTICLE_RULES: dict[str, Rule] = {
    "pdate": Rule(Selector(None, "class", "t11"), lambda text: F.substring(text, 1, 11)),
    "articleTitle": Rule(Selector("h3", "id", "articleTitle")),
    "article": Rule(Selector(None, "id", "articleBodyContents"), normalise_body),
    "pcompany": Rule(Selector("a", inside=Selector("address", inside=Selector(None, "id", "footer")), first_outer=True)),
    "aclass": Rule(Selector("em", "class", "guide_categorization_item")),
}
REQUIRED_FIELDS = ["pdate", "articleTitle", "article", "aclass"]


def extract_articles(pages: DataFrame, rules: Mapping[str, Rule] = ARTICLE_RULES) -> DataFrame:
    """``(pdate, articleTitle, article, pcompany, url, aclass, pub_date)`` of every page.

    A missing company is ``''``; any other missing field is null, see
    ``complete_articles`` and ``rejected_articles``. All elements of a page are found by one
    walk over its tags.
    """
    selected = {name: rule.selector for name, rule in rules.items() if rule.selector is not None}
    markups = element_markups(F.col("page"), list(selected.values()))
    found = pages.select("url", visible_markup(F.col("html")).alias("page")).select("url", "page", markups.alias("markups"))

    def field(name: str) -> Column:
        at = list(selected).index(name) if name in selected else None
        return rules[name].finish(F.col("page") if at is None else markup_text(F.col("markups")[at]))

    fields = F.struct(
        field("pdate").alias("pdate"),
        field("articleTitle").alias("articleTitle"),
        field("article").alias("article"),
        F.coalesce(field("pcompany"), F.lit("")).alias("pcompany"),
        F.col("url"),
        field("aclass").alias("aclass"),
    )
    # The one-element array keeps later filters on the fields from being evaluated
    # ahead of the extraction, which would run every pattern twice.
    rows = found.select(F.explode_outer(F.array(fields)).alias("a"))
    return rows.select("a.*", parse_date(F.col("a.pdate")).alias("pub_date"))


def _missing(required: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in required]))


def complete_articles(articles: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Articles that have all required fields."""
    return articles.where(F.size(_missing(required)) == 0)


def rejected_articles(articles: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Pages that lack a required field: ``(url, missing)``."""
    return articles.select("url", _missing(required).alias("missing")).where(F.size("missing") > 0)


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(\"[^\">]*\"|'[^'>]*'|[^\s\"'>]+)", 1)
    return decode_entities(F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit("")))


def page_links(pages: DataFrame, anchor: Selector, prefix: str) -> DataFrame:
    """All anchors of each page whose address starts with ``prefix``: ``(url, links)``."""
    tags = F.regexp_extract_all(visible_markup(F.col("html")), F.lit(f"(?is){anchor.open_tag()}"), F.lit(0))
    links = F.filter(F.transform(tags, lambda tag: _attribute(tag, "href")), lambda href: href.startswith(prefix))
    return pages.select("url", links.alias("links"))


def extract_links(pages: DataFrame, anchor: Selector, prefix: str) -> DataFrame:
    """One row per link: ``(url, position, href)``; pages without links give none."""
    exploded = page_links(pages, anchor, prefix).select("url", F.posexplode_outer("links").alias("position", "href"))
    return exploded.where(F.col("href").isNotNull())


def pages_without_links(pages: DataFrame, anchor: Selector, prefix: str) -> DataFrame:
    """Pages that have no such link, the end of a result list: ``(url)``."""
    return page_links(pages, anchor, prefix).where(F.size("links") == 0).select("url")


def extract_ranking(
    pages: DataFrame,
    base_url: str,
    sections: Sequence[Selector] = tuple(Selector("div", "id", name) for name in RANKING_SECTION_IDS),
    heading: Selector = Selector("h5"),
    depth: int = RANKING_DEPTH,
) -> DataFrame:
    """The first ``depth`` anchors of each section block.

    Other columns of ``pages`` than ``html``, such as the day and type of the ranking,
    are kept: ``(..., blind, position, href, title)``. An anchor without a ``title``
    attribute is titled by its text.
    """
    kept = [name for name in pages.columns if name != "html"]
    page = pages.select(*kept, visible_markup(F.col("html")).alias("page"))
    blocks = page.select(*kept, F.explode(section_anchors(F.col("page"), sections, heading, depth)).alias("block"))
    anchors = F.arrays_zip("block.opening", "block.inner")
    rows = blocks.select(*kept, markup_text(F.col("block.heading")).alias("blind"), F.posexplode(anchors).alias("position", "anchor"))
    text = markup_text(F.col("anchor.inner"))
    return rows.select(
        *kept,
        "blind",
        "position",
        F.concat(F.lit(base_url), _attribute(F.col("anchor.opening"), "href")).alias("href"),
        F.coalesce(_attribute(F.col("anchor.opening"), "title"), text).alias("title"),
    )


# The fields used of a script-wrapped and of a plain comment response.
JSONP_SCHEMA = (
    "result struct<count: struct<comment: bigint>, "
    "commentList: array<struct<contents: string, sympathyCount: bigint, antipathyCount: bigint>>>"
)
JSON_SCHEMA = (
    "array<struct<id: bigint, parentId: bigint, content: string, createdAt: timestamp, "
    "likeCount: bigint, dislikeCount: bigint>>"
)


def unwrap_callback(body: Column) -> Column:
    """The JSON inside ``callback(...)``; plain JSON stays as it is."""
    return F.regexp_replace(body, r"(?s)^\s*[\w.$]+\s*\(|\)\s*;?\s*\z", "")


def _parsed_jsonp(responses: DataFrame) -> DataFrame:
    return responses.select("url", F.from_json(unwrap_callback(F.col("body")), JSONP_SCHEMA)["result"].alias("result"))


def extract_comments_jsonp(responses: DataFrame) -> DataFrame:
    """``(url, comment, sympathyCount, antipathyCount)`` of ``responses(url, body)``.

    Responses that cannot be read give no row; see ``rejected_jsonp``.
    """
    exploded = _parsed_jsonp(responses).select("url", F.explode_outer("result.commentList").alias("c"))
    return exploded.where(F.col("c").isNotNull()).select(
        "url", F.col("c.contents").alias("comment"), "c.sympathyCount", "c.antipathyCount"
    )


def rejected_jsonp(responses: DataFrame) -> DataFrame:
    """Script-wrapped responses that hold no readable result, cut off ones for instance: ``(url, body)``."""
    parsed = F.from_json(unwrap_callback(F.col("body")), JSONP_SCHEMA)["result"]
    return responses.where(parsed.isNull()).select("url", "body")


def _json_list(body: Column) -> Column:
    """The comments of a plain response; null unless it is one whole JSON list.

    The reader takes a lone object for a list of one, so the bracket is asked for.
    """
    return F.when(body.rlike(r"^\s*\["), F.from_json(body, JSON_SCHEMA))


def rejected_json(responses: DataFrame) -> DataFrame:
    """Plain responses that are no whole list of comments: ``(url, body)``."""
    return responses.where(_json_list(F.col("body")).isNull()).select("url", "body")


def comment_completeness(responses: DataFrame) -> DataFrame:
    """Comments announced against comments landed: ``(url, announced, landed, complete)``."""
    sizes = _parsed_jsonp(responses).select(
        "url",
        F.col("result.count.comment").alias("announced"),
        F.coalesce(F.array_size("result.commentList"), F.lit(0)).cast("long").alias("landed"),
    )
    totals = sizes.groupBy("url").agg(F.max("announced").alias("announced"), F.sum("landed").alias("landed"))
    return totals.withColumn("complete", F.coalesce(F.col("announced") == F.col("landed"), F.lit(False)))


def parse_comments_json(responses: DataFrame) -> DataFrame:
    """All fields of the plain responses ``(url, body)``, one row per comment.

    Responses that are no whole list give no row; see ``rejected_json``.
    """
    parsed = responses.select("url", _json_list(F.col("body")).alias("comments"))
    exploded = parsed.select("url", F.explode_outer("comments").alias("c")).where(F.col("c").isNotNull())
    return exploded.select("url", "c.*")


def extract_comments_json(responses: DataFrame) -> DataFrame:
    """``(url, content, createdAt, likeCount, dislikeCount)`` of ``responses(url, body)``."""
    return parse_comments_json(responses).select("url", "content", "createdAt", "likeCount", "dislikeCount")


def url_params(pages: DataFrame, first: str = "oid", second: str = "aid") -> DataFrame:
    """Query parameters, last path segment and comment key of each ``url``."""
    one, two = (F.try_parse_url("url", F.lit("QUERY"), F.lit(name)) for name in (first, second))
    return pages.select(
        "url",
        one.alias(first),
        two.alias(second),
        F.element_at(F.split("url", "/", -1), -1).alias("post_id"),
        F.concat(F.lit("news"), one, F.lit(","), two).alias("object_id"),
    )
