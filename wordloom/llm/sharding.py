"""Sharding by a two-pass external shuffle.

Pass one scatters records into buckets that fit in memory, by a seeded hash of their
content. Pass two gives each bucket a Fisher-Yates order (Spark's ``shuffle`` of the
bucket's positions) and lays the buckets end to end; the line is cut into shards whose
row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.columns import replacing, with_offsets
from wordloom.session import checkpoint

SHARDS = 40
SEED = 20_24
# A bucket's records, of which a task orders one bucket at a time.
BUCKET_BYTES = 8 << 20
RECORD_BYTES = 16


def shuffle_into_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot``.

    ``slot`` counts from 0 without gaps in each shard; shards differ by one row at most.
    ``docs`` needs ``doc_id`` and ``text``; either may be null, and repeated rows are
    kept, each with a slot of its own. Columns named ``shard`` or ``slot`` are replaced.
    An empty table gives an empty table. The order of the buckets is fixed by ``seed``;
    the orders inside are written to the checkpoint folder before they are used, so a
    task that runs again places its rows as before.

    The records are moved once, by bucket. What is read to the driver is two numbers.
    """
    bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES
    rows, size = docs.select(bytes_of.alias("size")).agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, math.ceil((size or 0) / bucket_bytes))
    mark = F.xxhash64(F.lit(seed), "doc_id", "text")
    scattered = docs.withColumn("wl_mark", mark).withColumn("wl_bucket", F.pmod("wl_mark", F.lit(buckets)))
    counts = scattered.groupBy("wl_bucket").agg(F.count("*").alias("wl_rows"))
    order = F.shuffle(F.sequence(F.lit(0).cast("int"), (F.col("wl_rows") - 1).cast("int")), seed)
    orders = with_offsets(counts, [], "wl_bucket", "wl_rows", "wl_start").select("wl_bucket", "wl_start", order.alias("wl_order"))
    in_bucket = Window.partitionBy("wl_bucket").orderBy("wl_mark", "doc_id")
    placed = scattered.withColumn("wl_row", F.row_number().over(in_bucket)).join(checkpoint(orders), "wl_bucket")
    placed = placed.withColumn("wl_place", F.col("wl_start") + F.element_at("wl_order", F.col("wl_row")))
    placed = placed.drop("wl_mark", "wl_bucket", "wl_row", "wl_start", "wl_order")
    total = max(rows, 1)
    placed = replacing(placed, shard=F.expr(f"int(wl_place * {shards} div {total})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return replacing(placed, slot=F.col("wl_place") - first).drop("wl_place")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Write each shard as one folder of Parquet below ``folder``, its rows by slot.

    A shard is written by one task, which sorts on disk where memory is short.
    """
    shards = SHARDS if "shard" not in sharded.columns else sharded.agg(F.max("shard")).first()[0]
    ordered = sharded.repartition(max(1, (shards or 0) + 1), "shard").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(folder)


def sharding_digest(docs: DataFrame) -> DataFrame:
    """Place of every document with its size and checksum; a null text has neither bytes nor a name."""
    sized = docs.select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(sized).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
