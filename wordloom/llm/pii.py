"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Everything is column algebra inside the row: no shuffle, no Python. A pattern's matches
come from ``regexp_extract_all``, its gaps from ``split`` by the same pattern, and the
running length of gaps and matches gives the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import replacing

LOCAL = "A-Za-z0-9._%+-"
HOST = "[A-Za-z0-9-]++"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Code points before and after a match in which context words count.
CONTEXT = 40
# Spans of kinds beyond the base are kept from this score on.
KEEP_SCORE = 0.5
# Matches whose lengths are summed in one go.
RUN = 128


@dataclass(frozen=True)
class Kind:
    """``gate`` must occur in a text before ``pattern`` is tried; ``gate`` and ``pattern`` are regular expressions.

    Patterns match what the plain form does, without its backtracking over long runs: a
    possessive run cannot end earlier, and a start inside a run is only needed where the
    previous match ended. A confirmed match scores ``confirmed``, any other ``proposed``;
    a context word adds ``context_gain``. Base kinds keep confirmed matches whatever the
    score, others keep those of ``KEEP_SCORE`` or more.
    """

    name: str
    gate: str
    pattern: str
    context: str
    proposed: float
    confirmed: float
    context_gain: float = 0.2
    base: bool = False


# Lengths of account numbers by country, from the public register.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
# A number of a known country ends after its length, whatever capitals follow; others are taken as far as they go.
KNOWN_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
OTHER_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{HOST}(?:\.{HOST})++", "mail|contact|write|reach", 0.0, 0.8, base=True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|addr|host|server|login", 0.0, 0.6, base=True),
    Kind("card", "[0-9](?:[ -]?[0-9]){11}", "[0-9](?:[ -]?[0-9])++", "card|credit|visa|pay|debit", 0.0, 0.7, base=True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "phone|call|tel|mobile|fax", 0.0, 0.7, base=True),
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}",
        f"(?<![A-Za-z0-9])(?:{KNOWN_IBAN}|{OTHER_IBAN})",
        "iban|bank|account|konto|transfer|cuenta|compte",
        0.2,
        0.8,
    ),
    Kind("ssn", "[0-9]-[0-9]", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social security|taxpayer", 0.1, 0.3, 0.4),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    worth = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
    )
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, without spaces, has remainder 1 by 97 when rotated by four."""
    moved = F.concat(F.substring(value, 5, 100), F.substring(value, 1, 4))
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda rest, c: (rest * F.when(c >= "A", 100).otherwise(10) + code(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The checksum or rule of a kind."""
    size = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^(?:{OCTET}(?:\.|$)){{4}}$")
    if kind == "card":
        return F.when(size.between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def running_sum(values: Column) -> Column:
    """Sums of the first 1, 2, ... numbers; runs of ``RUN`` are summed first, so long arrays stay cheap."""
    add = lambda total, x: total + x
    zero = F.lit(0)
    runs = F.sequence(zero, F.floor(F.size(values) / RUN).cast("int"))
    of_runs = F.transform(runs, lambda r: F.aggregate(F.slice(values, r * RUN + 1, RUN), zero, add))
    before = F.aggregate(
        of_runs,
        F.array(zero),
        lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)),
    )
    number = lambda i: F.floor(i / RUN).cast("int")
    return F.transform(
        values,
        lambda x, i: F.get(before, number(i)) + F.aggregate(F.slice(values, number(i) * RUN + 1, i % RUN + 1), zero, add),
    )


def found(text: Column, kind: Kind, order: int) -> tuple[Column, Column]:
    """Matches of a kind with the gaps around them: arrays, empty where the gate is shut."""
    open_ = text.rlike(kind.gate)
    matches = F.when(open_, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(open_, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))
    return matches.alias(f"wl_matches{order}"), gaps.alias(f"wl_gaps{order}")


def spans_of(kind: Kind, order: int) -> Column:
    """Kept spans of a kind as structs of start, order of the kind, end and score."""
    matches, gaps, ends = F.col(f"wl_matches{order}"), F.col(f"wl_gaps{order}"), F.col(f"wl_ends{order}")

    def span(match: Column, i: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(CONTEXT))))
        gain = F.when(near.rlike(kind.context), kind.context_gain).otherwise(0.0)
        sure = confirmed(kind.name, match)
        end = F.get(ends, i)
        return F.struct(
            (end - F.length(match)).alias("start"),
            F.lit(order).alias("kind"),
            end.alias("end"),
            F.round(F.when(sure, kind.confirmed).otherwise(kind.proposed) + gain, 3).alias("score"),
            sure.alias("confirmed"),
        )

    every = F.transform(matches, span)
    return F.filter(every, lambda s: s["confirmed"] if kind.base else s["score"] >= KEEP_SCORE)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: all spans, by start and then in the order of ``KINDS``.

    Each span is a struct of ``start``, ``kind`` (a number into ``KINDS``), ``end``
    (code points, end exclusive), ``score`` and ``confirmed``. Matches of one kind do not
    overlap; kinds may. A null or empty text has an empty list. Rows, repeated ones
    included, keep their columns; a column named ``pii`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    numbered = list(enumerate(KINDS))
    proposed = docs.select("*", *[column for i, kind in numbered for column in found(text, kind, i)])
    steps = lambda i: F.transform(F.col(f"wl_matches{i}"), lambda m, at: F.length(m) + F.length(F.get(F.col(f"wl_gaps{i}"), at)))
    lengths = proposed.select("*", *[steps(i).alias(f"wl_steps{i}") for i, _ in numbered])
    placed = lengths.select("*", *[running_sum(F.col(f"wl_steps{i}")).alias(f"wl_ends{i}") for i, _ in numbered])
    spans = F.array_sort(F.concat(*[spans_of(kind, i) for i, kind in numbered]))
    result = replacing(placed, pii=spans)
    return result.drop(*[f"wl_{part}{i}" for i, _ in numbered for part in ("matches", "gaps", "steps", "ends")])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{kind.name}>") for kind in KINDS])
    found_ = find_pii(docs)

    def step(state: Column, span: Column) -> Column:
        free = span["start"] >= state["at"]
        before = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        piece = F.concat(state["out"], before, F.get(names, span["kind"]))
        return F.struct(F.when(free, piece).otherwise(state["out"]).alias("out"), F.when(free, span["end"]).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.lit(2**31 - 1)))
    masked = F.aggregate("pii", start, step, rest)
    return replacing(found_, text=F.when(F.size("pii") > 0, masked).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the places of all spans and their scores, one row a document."""
    spans = find_pii(docs.select("doc_id", "text"))
    bases = [i for i, kind in enumerate(KINDS) if kind.base]
    count = lambda i: F.size(F.filter("pii", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")
    base = F.filter("pii", lambda s: s["kind"].isin(bases))
    return spans.select(
        "doc_id",
        *[count(i) for i in bases],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
