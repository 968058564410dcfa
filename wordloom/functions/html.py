"""Column functions that pull elements and plain text out of raw HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache
from html.entities import name2codepoint

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.text import _once

# Entities for the ampersand; decoded last so that nothing is decoded twice.
_AMPERSAND = r"&amp;|&#0*38;|&#[xX]0*26;"


@dataclass(frozen=True)
class Selector:
    """An element to find: tag name, ``None`` for any, and, if given, one attribute it must carry.

    ``attribute='class'`` matches one of the blank-separated class names; any other
    attribute must equal ``value``. ``inside`` narrows the search to elements within any
    that match another selector, or within the first such one only.
    """

    tag: str | None
    attribute: str | None = None
    value: str | None = None
    inside: Selector | None = None
    first_outer: bool = False

    def open_tag(self) -> str:
        tag = self.tag or "[a-z][a-z0-9]*"
        if self.attribute is None:
            return rf"<{tag}(?:\s[^>]*)?>"
        quoted = re.escape(self.value)
        if self.attribute == "class":
            quoted = rf"(?:[^\"'>]*\s)?{quoted}(?:\s[^\"'>]*)?"
        return rf"<{tag}\s(?:[^>]*\s)?{self.attribute}\s*=\s*[\"']?{quoted}(?:[\"'\s][^>]*)?>"


def visible_markup(html: Column) -> Column:
    """The markup without comments, scripts and styles, whose text is not shown."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>", ""
    )


@dataclass(frozen=True)
class Element:
    """An element of a page: its opening tag, and where its inner markup lies."""

    tag: str
    opening: str
    start: int
    end: int


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*)?>")


def page_elements(page: str) -> list[Element]:
    """All elements of a page in order, from one walk over its tags.

    A closing tag ends the last open element of its name, so elements that stand across each other
    are kept apart by name. An element that is never closed reaches to the end of the page.
    """
    found: list[tuple[str, str, int]] = []
    ends: dict[int, int] = {}
    still_open: dict[str, list[int]] = {}
    for tag in _TAG.finditer(page):
        name = tag[2].lower()
        if not tag[1]:
            still_open.setdefault(name, []).append(len(found))
            found.append((name, tag[0], tag.end()))
        elif still_open.get(name):
            ends[still_open[name].pop()] = tag.start()
    return [Element(*element, ends.get(i, len(page))) for i, element in enumerate(found)]


def matching(elements: list[Element], selector: Selector) -> list[Element]:
    """The elements that match, in order; with ``inside``, those in any element that matches it."""
    tag, opening = selector.tag and selector.tag.lower(), re.compile(f"(?is){selector.open_tag()}")
    near = [e for e in elements if (tag is None or e.tag == tag) and (selector.attribute is None or opening.fullmatch(e.opening))]
    if selector.inside is None:
        return near
    outer = matching(elements, selector.inside)
    if selector.first_outer:
        outer = outer[:1]
    # Reach of the outer elements so far; an element inside any of them starts before the furthest end.
    found, reach, at = [], -1, 0
    for element in near:
        while at < len(outer) and outer[at].start <= element.start - len(element.opening):
            reach = max(reach, outer[at].end)
            at += 1
        if element.start <= reach:
            found.append(element)
    return found


def written(selectors: Sequence[Selector]) -> Column:
    """Selectors as a constant column."""
    return F.lit(json.dumps([asdict(selector) for selector in selectors], ensure_ascii=False))


@lru_cache(maxsize=256)
def _read_selectors(text: str) -> tuple[Selector, ...]:
    def selector(fields: dict) -> Selector:
        return Selector(**{**fields, "inside": fields["inside"] and selector(fields["inside"])})

    return tuple(map(selector, json.loads(text)))


# Pages whose texts a task holds as Python strings at a time; the rest of a batch stays in Arrow.
HELD_PAGES = 64


@F.arrow_udf(T.ArrayType(T.StringType()))
def _first_markups(pages: pa.Array, selectors: pa.Array) -> pa.Array:
    def firsts(page: str | None, text: str) -> list[str | None]:
        elements = page_elements(page) if page is not None else []
        found = [next(iter(matching(elements, selector)), None) for selector in _read_selectors(text)]
        return [None if e is None else page[e.start : e.end] for e in found]

    kind = pa.list_(pa.string())
    parts = [pa.array([], kind)]
    for start in range(0, len(pages), HELD_PAGES):
        some = zip(pages.slice(start, HELD_PAGES).to_pylist(), selectors.slice(start, HELD_PAGES).to_pylist(), strict=True)
        parts.append(pa.array([firsts(page, text) for page, text in some], kind))
    return pa.concat_arrays(parts)


def element_markups(markup: Column, selectors: Sequence[Selector]) -> Column:
    """Inner markup of the first element that matches each selector, null where there is none, from one walk."""
    return _first_markups(markup, written(selectors))


def element_markup(markup: Column, selector: Selector) -> Column:
    """Inner markup of the first element that matches; null if there is none."""
    return element_markups(markup, [selector])[0]


@F.pandas_udf(
    T.ArrayType(
        T.StructType(
            [
                T.StructField("section", T.IntegerType()),
                T.StructField("heading", T.StringType()),
                T.StructField("opening", T.ArrayType(T.StringType())),
                T.StructField("inner", T.ArrayType(T.StringType())),
            ]
        )
    )
)
def _section_anchors(pages: pd.Series, selectors: pd.Series, depth: pd.Series) -> pd.Series:
    found = []
    for page, text, most in zip(pages, selectors, depth, strict=True):
        heading, *sections = _read_selectors(text)
        elements = page_elements(page) if page is not None else []
        blocks = []
        for number, section in enumerate(sections):
            block = next(iter(matching(elements, section)), None)
            if block is not None:
                inside = [e for e in elements if block.start <= e.start - len(e.opening) and e.start <= block.end]
                head = next(iter(matching(inside, heading)), None)
                anchors = matching(inside, Selector("a"))[: int(most)]
                texts = [page[e.start : e.end] for e in anchors]
                blocks.append((number, head and page[head.start : head.end], [e.opening for e in anchors], texts))
        found.append(blocks)
    return pd.Series(found, dtype=object)


def section_anchors(markup: Column, sections: Sequence[Selector], heading: Selector, depth: int) -> Column:
    """For each section found: its number, its heading's markup, and tags and markup of its first anchors, from one walk."""
    return _section_anchors(markup, written([heading, *sections]), F.lit(depth))


def decode_entities(text: Column) -> Column:
    """Replace character references, named (HTML 4 names) and numeric."""
    named = {name: chr(code) for name, code in name2codepoint.items() if name != "amp"}
    named["apos"] = "'"
    table = F.create_map(*[F.lit(part) for item in sorted(named.items()) for part in item])

    def decode(t: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(t, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
        after_names = F.aggregate(
            names,
            t,
            lambda acc, name: F.coalesce(
                F.replace(acc, F.concat(F.lit("&"), name, F.lit(";")), F.try_element_at(table, name)), acc
            ),
        )
        return _once(after_names, decode_numeric)

    def decode_numeric(t: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(t, F.lit("&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"), F.lit(1)))
        return F.aggregate(
            refs,
            t,
            lambda acc, ref: F.coalesce(F.replace(acc, F.concat(F.lit("&"), ref, F.lit(";")), character(ref)), acc),
        )

    def character(ref: Column) -> Column:
        is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
        code = F.when(
            is_hex, F.conv(F.lower(F.regexp_replace(ref, "^#[xX]", "")), 16, 10)
        ).otherwise(F.regexp_replace(ref, "^#", "")).cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    decoded = _once(text, lambda t: F.when(F.contains(t, F.lit("&")), decode(t)).otherwise(t))
    return F.regexp_replace(decoded, _AMPERSAND, "&")


def html_to_text(markup: Column) -> Column:
    """Text nodes joined without a separator, character references decoded."""
    return decode_entities(F.regexp_replace(visible_markup(markup), "<[^>]+>", ""))


def markup_text(markup: Column) -> Column:
    """Text of markup that went through ``visible_markup``."""
    return decode_entities(F.regexp_replace(markup, "<[^>]+>", ""))


def element_text(markup: Column, selector: Selector) -> Column:
    """Text of the first matching element of markup that went through ``visible_markup``."""
    return markup_text(element_markup(markup, selector))
