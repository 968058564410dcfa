"""Column expressions and small table helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A-Z only, other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Keys of a prefix sum that one task orders; the sums of the chunks are ordered by another.
CHUNK = 4096


def struct(**kinds: T.DataType) -> T.StructType:
    """A row type; unlike its text form it needs no session, so modules can be imported without one."""
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def spaced_word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def replacing(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added at the end; columns of those names, in any case, give way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])


def with_offsets(counts: DataFrame, groups: list[str], key: str, count: str, offset: str) -> DataFrame:
    """Add ``offset``: the sum of ``count`` over smaller keys of the same group.

    Keys are whole numbers from 0, one row each. The sum runs within chunks of ``CHUNK``
    keys and then over the chunks, so no task orders more than one chunk or one row a
    chunk. The groups must not be null.
    """
    chunked = counts.withColumn("wl_chunk", F.expr(f"`{key}` div {CHUNK}"))
    before = Window.orderBy("wl_chunk").rowsBetween(Window.unboundedPreceding, -1)
    if groups:
        before = Window.partitionBy(*groups).orderBy("wl_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunked.groupBy(*groups, "wl_chunk").agg(F.sum(count).alias("wl_sum"))
    chunks = chunks.withColumn("wl_before", F.coalesce(F.sum("wl_sum").over(before), F.lit(0))).drop("wl_sum")
    inside = Window.partitionBy(*groups, "wl_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = chunked.withColumn("wl_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    joined = summed.join(chunks, [*groups, "wl_chunk"])
    return joined.withColumn(offset, F.col("wl_before") + F.col("wl_inside")).drop("wl_before", "wl_inside", "wl_chunk")


def row_keys() -> list[Column]:
    """``wl_key, wl_key2``: two digests of a row's ``doc_id`` and ``text``, by which results find their rows."""
    return [
        F.xxhash64("doc_id", "text").alias("wl_key"),
        F.xxhash64("text", "doc_id", F.lit(1)).alias("wl_key2"),
    ]
