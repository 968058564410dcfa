"""Mixing sources to target weights with a low-discrepancy schedule.

Sources get weights, weights give targets in words. Each source's documents are laid end
to end in a seeded shuffled order and cut into blocks of equal length; the line starts again at its
end and stops at the target, so repeats and the last block are exact to the word. The
points of a golden-ratio sequence are mapped through the cumulative numbers of blocks to
sources; the points of a source are ranked, and rank r takes block r of the source's line.
Points of a source whose line has ended are passed over, the others are the slots of the
mix. What has a slot is in the mix, nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.columns import replacing, spaced_word_count, with_offsets
from wordloom.session import checkpoint

SEED = "mix-1"
BLOCK_WORDS = 64
MAX_REPEATS = 3
WEIGHT_CYCLE = 3
# Documents that one task orders.
BUCKET_ROWS = 20_000
# Golden-ratio steps in whole numbers: STEP / PERIOD is the golden section, and the
# product of two numbers below PERIOD fits in a long.
PERIOD = 1 << 31
STEP = 1_327_217_885
# Cells of [0, 1) by which points find the source whose interval holds them.
CELLS = 1024
SLOT_CHUNK = 65_536
# Golden-ratio points in an interval are fewer than their even share by less than this.
UNEVEN = 8


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets per source from ``source, source_size``, one row a source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the words of all.
    A target stops at ``max_repeats`` times the source's size and the excess goes to the
    others by weight, until none is above: with sources ordered by limit over weight, the
    level is the first that stays within the next limit. Returns ``source, source_size,
    wl_source`` (0, 1, ...)``, target``. The windows are over sources, of which there are few.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("wl_source", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("wl_weight", (F.col("wl_source") % WEIGHT_CYCLE + 1).cast("double"))
    ranked = ranked.withColumn("wl_limit", (F.col("source_size") * max_repeats).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy(F.col("wl_limit") / F.col("wl_weight"), "wl_source")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("wl_limit").over(earlier), F.lit(0.0))) / F.sum("wl_weight").over(onwards)
    fits = ranked.withColumn("wl_level", level).withColumn("wl_total", total)
    fits = fits.withColumn("wl_ratio", F.col("wl_limit") / F.col("wl_weight"))
    chosen = F.min(F.when(F.col("wl_level") <= F.col("wl_ratio"), F.struct("wl_ratio", "wl_source", "wl_level"))).over(everything)
    level = F.coalesce(chosen["wl_level"], F.lit(0.0))
    leveled = fits.withColumn("target", F.least("wl_limit", F.col("wl_weight") * level))
    return leveled.select("source", "source_size", "wl_source", "target")


def line_words() -> Column:
    """Words of a source's line up to its target."""
    return F.least(F.round("target").cast("long"), F.col("source_size") * MAX_REPEATS)


def placed_documents(docs: DataFrame, size: Column, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` without their text on the lines of their sources, and the table of sources; sizes are worked out once and written.

    Added: ``size, source_size, target, wl_source, wl_start`` (words before the document
    in its source's shuffled line), ``wl_bucket, wl_row`` (a name for the row) and
    ``wl_words`` (the words its source gives). The order comes from a digest of seed, id
    and text, so reruns agree; equal rows may swap, which changes nothing.
    """
    content = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce("text", F.lit("")))
    sized = replacing(docs, size=size).withColumn("wl_mark", F.md5(content.cast("binary")))
    sized = checkpoint(sized.drop("text"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("wl_rows"))
    per_source = checkpoint(per_source)
    rows = per_source.agg(F.sum("wl_rows")).first()[0] or 0
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    sources = checkpoint(source_targets(per_source.drop("wl_rows")))
    names = sources.select(F.col("source").alias("wl_name"), "source_size", "target", "wl_source")
    sized = sized.drop("source_size", "target")
    known = sized.join(names, sized["source"].eqNullSafe(names["wl_name"])).drop("wl_name")
    first = F.conv(F.substring("wl_mark", 1, 8), 16, 10).cast("long")
    known = known.withColumn("wl_bucket", F.shiftright(first * buckets, 32))
    sums = checkpoint(known.groupBy("wl_source", "wl_bucket").agg(F.sum("size").alias("wl_sum")))
    offsets = checkpoint(with_offsets(sums, ["wl_source"], "wl_bucket", "wl_sum", "wl_offset").drop("wl_sum"))
    in_bucket = Window.partitionBy("wl_source", "wl_bucket").orderBy("wl_mark", "size")
    before = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    line = known.withColumn("wl_row", F.row_number().over(in_bucket)).withColumn("wl_inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    line = line.join(offsets, ["wl_source", "wl_bucket"]).withColumn("wl_start", F.col("wl_offset") + F.col("wl_inside"))
    line = line.withColumn("wl_words", line_words())
    return line.drop("wl_mark", "wl_inside", "wl_offset"), sources


def schedule(sources: DataFrame, total: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``wl_source, wl_block, slot``: the source of every slot and the block it takes there.

    ``sources`` is a table of ``source_targets``, ``total`` the words of all sources. Every
    block up to a source's target has one slot; slots are numbered without gaps.
    """
    lines = sources.withColumn("wl_blocks", F.ceil(line_words() / block_words)).where("wl_blocks > 0")
    in_order = Window.partitionBy(F.lit(0)).orderBy("wl_source")
    every = Window.partitionBy(F.lit(0))
    edge = lambda blocks: F.coalesce(blocks, F.lit(0)) / F.sum("wl_blocks").over(every)
    lines = lines.select(
        "wl_source",
        "wl_blocks",
        edge(F.sum("wl_blocks").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).alias("wl_low"),
        edge(F.sum("wl_blocks").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).alias("wl_high"),
    )
    # By this many points a source surely has as many as it has blocks.
    lines = lines.withColumn("wl_end", F.ceil((F.col("wl_blocks") + UNEVEN) / (F.col("wl_high") - F.col("wl_low"))))
    lines = checkpoint(lines)
    points = lines.agg(F.max("wl_end")).first()[0] if total else None
    point = F.expr(f"(id % {PERIOD}L) * {STEP}L % {PERIOD}L / double({PERIOD})")
    drawn = sources.sparkSession.range(points or 0).select(F.col("id").alias("wl_id"), point.alias("wl_point"))
    drawn = drawn.withColumn("wl_cell", F.floor(F.col("wl_point") * CELLS))
    cell = lambda edge: F.least(F.floor(F.col(edge) * CELLS), F.lit(CELLS - 1))
    spread = lines.withColumn("wl_cell", F.explode(F.sequence(cell("wl_low"), cell("wl_high"))))
    held = (F.col("wl_point") >= F.col("wl_low")) & (F.col("wl_point") < F.col("wl_high")) & (F.col("wl_id") < F.col("wl_end"))
    drawn = drawn.join(spread, "wl_cell").where(held).withColumn("wl_chunk", F.expr(f"wl_id div {SLOT_CHUNK}"))
    drawn = drawn.select("wl_source", "wl_blocks", "wl_chunk", "wl_id")
    ranked = ranked_in_chunks(drawn, ["wl_source"], "wl_block").where(F.col("wl_block") < F.col("wl_blocks"))
    ranked = checkpoint(ranked.drop("wl_blocks"))
    return ranked_in_chunks(ranked, [], "slot").select("wl_source", "wl_block", "slot")


def ranked_in_chunks(points: DataFrame, groups: list[str], name: str) -> DataFrame:
    """``points`` with their number from 0, in order of ``wl_id``, in their group; chunks are ordered one by one.

    The chunks' counts and offsets are written, else a plan holds what leads to ``points`` four times.
    """
    counts = checkpoint(points.groupBy(*groups, F.col("wl_chunk").alias("wl_key")).agg(F.count("*").alias("wl_count")))
    offsets = with_offsets(counts, groups, "wl_key", "wl_count", "wl_offset")
    offsets = checkpoint(offsets.select(*groups, F.col("wl_key").alias("wl_chunk"), "wl_offset"))
    in_chunk = Window.partitionBy(*groups, "wl_chunk").orderBy("wl_id")
    ranked = points.withColumn("wl_rank", F.row_number().over(in_chunk) - 1).join(offsets, [*groups, "wl_chunk"])
    return ranked.withColumn(name, F.col("wl_offset") + F.col("wl_rank")).drop("wl_offset", "wl_rank")


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """Pieces of documents in the order of the mix.

    One row for each piece of a document in a block: the columns of ``placed_documents``
    without the text, ``epoch`` (0 to 2), ``slot`` (place of the block in the mix) and
    ``words``. Pieces in blocks without a slot have 0 words. Documents beyond the target
    have one row with null ``epoch`` and ``words`` 0. Null texts have no words; null
    sources are a source; nothing is dropped.
    """
    placed, sources = placed_documents(docs, spaced_word_count(F.col("text")), seed)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    epochs = F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))
    start = lambda epoch: F.col("wl_start") + epoch * F.col("source_size")
    ends = lambda epoch: F.least(start(epoch) + F.col("size"), F.col("wl_words"))
    used = F.filter(epochs, lambda epoch: (start(epoch) < ends(epoch)) & (F.col("size") > 0))
    parts = placed.withColumn("epoch", F.explode_outer(used))
    epoch = F.col("epoch")
    parts = parts.withColumn("wl_from", start(epoch)).withColumn("wl_to", ends(epoch))
    blocks = F.when(epoch.isNotNull(), F.sequence(F.expr(f"wl_from div {block_words}"), F.expr(f"(wl_to - 1) div {block_words}")))
    pieces = parts.withColumn("wl_block", F.explode_outer(blocks))
    low = F.greatest("wl_from", F.col("wl_block") * block_words)
    high = F.least("wl_to", (F.col("wl_block") + 1) * block_words)
    joined = pieces.join(schedule(sources, total, block_words), ["wl_source", "wl_block"], "left")
    return joined.withColumn("words", F.when(F.col("slot").isNull(), F.lit(0)).otherwise(high - low))


def mix_documents(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` as the mix holds them: once for each epoch that takes half of one or more.

    A document stands at the slot of the block it starts in; rows are in order of slots.
    Documents beyond their source's target are left out, those of short sources repeat,
    up to three times. Documents without words have no place in the mix. Columns are those
    of ``docs``; rows that repeat are documents of their own.
    """
    columns = [F.col(f"`{name}`") for name in docs.columns]
    keyed = docs.select("*", F.xxhash64(*columns).alias("wl_key"), F.xxhash64(F.lit(1), *columns).alias("wl_key2"))
    narrow = keyed.select("wl_key", "wl_key2", "doc_id", "text", "source")
    placed, sources = placed_documents(narrow, spaced_word_count(F.col("text")), seed)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    start = lambda epoch: F.col("wl_start") + epoch * F.col("source_size")
    epochs = F.filter(
        F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)),
        lambda epoch: (F.col("size") > 0) & (F.least(F.col("wl_words") - start(epoch), F.col("size")) * 2 >= F.col("size")),
    )
    repeated = placed.withColumn("wl_epoch", F.explode(epochs)).withColumn("wl_from", start(F.col("wl_epoch")))
    repeated = repeated.withColumn("wl_block", F.expr(f"wl_from div {block_words}"))
    in_mix = repeated.join(schedule(sources, total, block_words), ["wl_source", "wl_block"])
    in_mix = checkpoint(in_mix.select("wl_key", "wl_key2", F.col("slot").alias("wl_slot"), "wl_from"))
    # Texts come back when all places are known; one row stands for all that equal it in every column.
    whole = in_mix.join(keyed.dropDuplicates(["wl_key", "wl_key2"]), ["wl_key", "wl_key2"])
    ordered = whole.repartitionByRange("wl_slot", "wl_from").sortWithinPartitions("wl_slot", "wl_from")
    return ordered.select(*columns)


def mixing_digest(docs: DataFrame) -> DataFrame:
    """Words that the mix takes from every document, the first slot that holds any, and in how many pieces."""
    pieces = mix_blocks(docs.select("doc_id", "text", "source"))
    row = ["wl_source", "wl_bucket", "wl_row"]
    return pieces.groupBy(*row).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("words").alias("taken"),
        F.min("slot").alias("first_slot"),
        F.count("slot").alias("n_pieces"),
    ).drop(*row)
