"""Column functions on text: cleaning, tokens, halves, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.constants import BODY_BOILERPLATE, CLEAN_STEPS, QUOTES, SPACE, SYMBOLS, WORD


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Apply ``use`` to ``value`` so that ``value`` is evaluated a single time.

    A lambda variable stands in for the value; plain nesting would copy the whole
    expression at every mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_step(text: Column, name: str) -> Column:
    """Remove what one named cleaning step removes.

    Texts lacking the literal that every match contains skip the pattern, which
    spares the quadratic scans some patterns make over long runs of letters.
    """
    # Deleting single characters is several times faster without a pattern.
    if name == "symbols":
        return F.translate(text, SYMBOLS, "")
    if name == "quotes":
        return F.translate(text, QUOTES, "")
    literal, pattern = next((lit, pat) for step, lit, pat in CLEAN_STEPS if step == name)
    if literal is None:
        return F.regexp_replace(text, pattern, "")
    return _once(
        text,
        lambda t: F.when(F.contains(t, F.lit(literal)), F.regexp_replace(t, pattern, "")).otherwise(t),
    )


def clean_text(text: Column) -> Column:
    """All nineteen cleaning steps in order."""
    for name, _, _ in CLEAN_STEPS:
        text = clean_step(text, name)
    return text


def strip_space(text: Column) -> Column:
    """Strip Unicode white space from both ends; SQL ``trim`` takes only blanks."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalise_body(text: Column, boilerplate: str = BODY_BOILERPLATE) -> Column:
    """Line feeds to blanks, then drop the boilerplate, then strip.

    The boilerplate is matched after line feeds have become blanks.
    """
    one_line = F.replace(text, F.lit("\n"), F.lit(" "))
    return strip_space(F.replace(one_line, F.lit(boilerplate), F.lit("")))


def tokenize(text: Column, min_token_len: int = 2) -> Column:
    """Lower-cased runs of word characters of at least ``min_token_len`` characters."""
    if min_token_len < 1:
        raise ValueError("min_token_len must be at least 1")
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{{min_token_len},}}"), F.lit(0))


def text_halves(text: Column) -> Column:
    """The text cut in two at half its blank-separated words, as an array of two."""
    def cut(words: Column) -> Column:
        half = F.floor(F.size(words) / 2).cast("int")
        return F.array(
            F.array_join(F.slice(words, F.lit(1), half), " "),
            F.array_join(F.slice(words, half + 1, F.size(words)), " "),
        )

    return _once(F.split(text, " ", -1), cut)


def normalise_date(text: Column) -> Column:
    """``2019.10.03`` or ``2019-10-03`` (also with a trailing dot) to ``20191003``."""
    return F.regexp_replace(text, "[.-]", "")


def parse_date(text: Column) -> Column:
    """Any of the date spellings to a date; null where it is none."""
    return F.try_to_timestamp(F.trim(normalise_date(text)), F.lit("yyyyMMdd")).cast("date")
