"""Benchmark decontamination by a distributed positional inverted index.

The index holds the postings (document, position, term) of every corpus word that some
benchmark item holds. For each window of an item, the lists of its two rarest terms are
intersected first, offset-adjusted: a posting at position p of the term at place i stands
for the alignment p - i of the item with the document. Alignments on which both terms of
a window meet are then looked up in the lists of the other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.columns import ascii_lower, row_keys
from wordloom.session import checkpoint

# What stands between words, ASCII other than letters and digits. The characters are listed one by
# one: Java looks those up in a bit set and tries ranges one after the other.
GAP = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WINDOW = 10
# Proximity: how far a word may stand from its place, and how many of a window's words must be near.
SLOP = 3
NEAR_WORDS = 8
# Postings of 2 ** STRETCH_BITS words of a document are shuffled and looked up together, so
# that a shuffled block names its document once and not with every posting.
STRETCH_BITS = 7
# Stretches with an alignment to look at are marked in so many buckets; other postings are not shuffled.
BUCKET_BITS = 20

# The term of the posting that ends each document; its position is the number of words.
END = -1
KEY = ["wl_key", "wl_key2"]
ALIGNED = [*KEY, "wl_item", "wl_shift"]


def pieces(text: Column) -> Column:
    """Words of a text as they are written, between two empty strings; only those for null.

    A match of a pattern costs several times what a piece of a split does.
    """
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), GAP)


def lower_word(word: Column) -> Column:
    """``word`` with A-Z in lower case; ``lower`` is faster and does the same to a word that is all ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(ascii_lower(word))


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.array_remove(pieces(ascii_lower(text)), "")


def item_places(items: DataFrame) -> DataFrame:
    """``wl_item, wl_place, wl_word`` of all items; repeated items count once, null texts have no words."""
    named = items.select(F.col("item_id").cast("string").alias("wl_item"), words(F.col("text")).alias("wl_words"))
    texts = named.where("wl_item is not null").distinct()
    # Rows that share an id are told apart by their words, and named alike in the result.
    label = F.struct("wl_item", F.xxhash64(F.array_join("wl_words", " ")).alias("version"))
    return texts.select(label.alias("wl_item"), F.posexplode("wl_words").alias("wl_place", "wl_word"))


def build_index(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored index and the vocabulary ``wl_word, wl_term``.

    The index has ``wl_key, wl_key2`` (digests of id and text), ``wl_pos``, ``wl_term``,
    and for each row of ``docs`` one posting of the term ``END`` with ``doc_id``. The
    vocabulary is written first, so its true size decides how it is joined. Documents
    are read once and not shuffled.
    """
    vocabulary = places.select("wl_word").distinct().withColumn("wl_term", F.monotonically_increasing_id())
    end = docs.sparkSession.range(1).select(F.lit("").alias("wl_word"), F.lit(END).cast("long").alias("wl_term"))
    vocabulary = checkpoint(vocabulary.unionByName(end))
    keyed = docs.select("doc_id", *row_keys(), pieces(F.col("text")).alias("wl_words"))
    # No list is empty. For the inner form Spark adds a filter on its size, which splits each text once more.
    placed = keyed.select("doc_id", *KEY, F.posexplode_outer("wl_words").alias("wl_at", "wl_written"))
    # The empty string before the words is left out, the one behind them is the posting of ``END``.
    listed = placed.where("wl_at > 0").select("doc_id", *KEY, (F.col("wl_at") - 1).alias("wl_pos"), lower_word(F.col("wl_written")).alias("wl_word"))
    postings = listed.join(vocabulary, "wl_word")
    owner = F.when(F.col("wl_term") == END, F.col("doc_id")).alias("doc_id")
    return checkpoint(postings.select(*KEY, "wl_pos", "wl_term", owner)), vocabulary


def windows_of(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Windows whose words all occur in the corpus: ``wl_item, wl_from, wl_length`` and the places of their two rarest terms."""
    per_item = Window.partitionBy("wl_item")
    sized = places.join(counts, "wl_term", "left").withColumn("wl_words", F.count("*").over(per_item))
    length = F.least(F.col("wl_words"), F.lit(window)).cast("int")
    starts = F.sequence(F.greatest(F.lit(0), F.col("wl_place") - length + 1), F.least(F.col("wl_place"), (F.col("wl_words") - length).cast("int")))
    member = sized.select("wl_item", "wl_place", "wl_count", length.alias("wl_length"), F.explode(starts).alias("wl_from"))
    lists = member.groupBy("wl_item", "wl_from", "wl_length").agg(
        F.count("wl_count").alias("wl_known"), F.sort_array(F.collect_list(F.struct("wl_count", "wl_place"))).alias("wl_lists")
    )
    whole = lists.where("wl_known = wl_length")
    rarest = F.col("wl_lists")[0]["wl_place"]
    second = F.coalesce(F.get("wl_lists", F.lit(1))["wl_place"], rarest)
    return whole.select("wl_item", "wl_from", "wl_length", rarest.alias("wl_first"), second.alias("wl_second"))


def alignments(index: DataFrame, places: DataFrame, windows: DataFrame) -> DataFrame:
    """Alignments where the two rarest terms of a window meet, with ``wl_open``: those windows' starts and lengths.

    The places seen on an alignment are bits of one number, which costs a task far less than
    a set; place ``p`` is bit ``p % 64``. Places 64 words apart in a longer item share a bit,
    so some windows of such items are open although their two terms do not meet.
    """
    anchor = windows.select("wl_item", F.explode(F.array("wl_first", "wl_second")).alias("wl_place")).distinct()
    anchors = checkpoint(anchor.join(places, ["wl_item", "wl_place"]).select("wl_item", "wl_place", "wl_term"))
    met = index.where(F.col("wl_term") != END).join(anchors, "wl_term")
    bit = F.expr("shiftleft(1L, wl_place % 64)").alias("wl_bit")
    shifted = met.select(*KEY, "wl_item", (F.col("wl_pos") - F.col("wl_place")).alias("wl_shift"), bit)
    # A document that starts in the middle of an item has negative shifts.
    seen = shifted.groupBy(*ALIGNED).agg(F.bit_or("wl_bit").alias("wl_seen"))
    pair = F.struct("wl_from", "wl_length", F.expr("shiftleft(1L, wl_first % 64) | shiftleft(1L, wl_second % 64)").alias("wl_both"))
    paired = windows.select("wl_item", pair.alias("wl_pair"))
    by_item = paired.groupBy("wl_item").agg(F.collect_list("wl_pair").alias("wl_windows"), F.min(F.bit_count("wl_pair.wl_both")).alias("wl_least"))
    both = F.filter("wl_windows", lambda w: F.col("wl_seen").bitwiseAND(w["wl_both"]) == w["wl_both"])
    # On most alignments one place is seen: they go before any window is looked at.
    several = seen.join(checkpoint(by_item), "wl_item").where(F.bit_count("wl_seen") >= F.col("wl_least"))
    open_ = several.withColumn("wl_both", both).where(F.size("wl_both") > 0)
    return open_.select(*ALIGNED, F.transform("wl_both", lambda w: F.struct(w["wl_from"].alias("wl_from"), w["wl_length"].alias("wl_length"))).alias("wl_open"))


def exact_matches(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``wl_key, wl_key2, wl_item`` and ``wl_hits``, the positions of words inside occurrences of the item's windows.

    One row for each alignment of an item with a document on which some window occurs
    whole. Lists of rare terms are small whatever the corpus; a frequent term is only
    looked up at the positions that the rare ones leave.
    """
    counts = checkpoint(index.where(F.col("wl_term") != END).groupBy("wl_term").agg(F.count("*").alias("wl_count")))
    windows = checkpoint(windows_of(places, counts, window))
    aligned = alignments(index, places, windows)
    covered = F.array_distinct(F.flatten(F.transform("wl_open", lambda w: F.sequence(w["wl_from"], w["wl_from"] + w["wl_length"] - 1))))
    wanted = aligned.select(*ALIGNED, "wl_open", F.explode(covered).alias("wl_place")).join(places, ["wl_item", "wl_place"])
    wanted = checkpoint(wanted.select(*ALIGNED, "wl_place", "wl_term", (F.col("wl_shift") + F.col("wl_place")).alias("wl_pos"), "wl_open"))
    # Dealt by document and stretch of text, not by posting, so that a shuffled list names its document once.
    stretch = F.shiftright("wl_pos", STRETCH_BITS)
    bucket = F.xxhash64("wl_key", "wl_stretch").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("wl_bucket")
    placed = wanted.withColumn("wl_stretch", stretch)
    # Of any corpus at most 2 ** BUCKET_BITS whole numbers, so the hint is safe: few megabytes.
    marked = F.broadcast(checkpoint(placed.select(bucket).distinct()))
    lists = index.select(*KEY, F.col("wl_pos").alias("wl_at"), F.col("wl_term").alias("wl_held"), stretch.alias("wl_stretch"))
    lists = lists.select("*", bucket).join(marked, "wl_bucket", "left_semi").drop("wl_bucket")
    same = F.expr("wl_at - wl_pos = 0 and wl_held - wl_term = 0")
    met = placed.join(lists, [*KEY, "wl_stretch"]).where(same)
    rows = met.groupBy(*ALIGNED).agg(F.collect_set("wl_place").alias("wl_met"), F.first("wl_open").alias("wl_open"))
    span = lambda w: F.sequence(w["wl_from"], w["wl_from"] + w["wl_length"] - 1)
    whole = F.filter("wl_open", lambda w: F.size(F.array_except(span(w), F.col("wl_met"))) == 0)
    hit = F.array_distinct(F.flatten(F.transform("wl_whole", span)))
    found = rows.withColumn("wl_whole", whole).where(F.size("wl_whole") > 0)
    return found.select(*KEY, "wl_item", F.transform(hit, lambda place: place + F.col("wl_shift")).alias("wl_hits"))


def proximity_matches(index: DataFrame, places: DataFrame, window: int = WINDOW, slop: int = SLOP, near: int = NEAR_WORDS) -> DataFrame:
    """Windows of items that documents hold loosely: ``doc keys, wl_item, wl_from, wl_shift, wl_near``.

    The rarest term of a window fixes the alignment; another word is near if it stands at
    most ``slop`` words from its place. Rows have ``near`` such words or more, the rarest
    included, or all of a shorter window.
    """
    counts = checkpoint(index.where(F.col("wl_term") != END).groupBy("wl_term").agg(F.count("*").alias("wl_count")))
    windows = checkpoint(windows_of(places, counts, window))
    anchors = windows.join(places, (F.col("wl_first") == places["wl_place"]) & (windows["wl_item"] == places["wl_item"]))
    anchors = checkpoint(anchors.select(windows["wl_item"], "wl_from", "wl_length", "wl_first", "wl_term"))
    aligned = index.join(anchors, "wl_term").select(*ALIGNED[:3], "wl_from", "wl_length", (F.col("wl_pos") - F.col("wl_first")).alias("wl_shift"))
    span = F.sequence(F.col("wl_from"), F.col("wl_from") + F.col("wl_length") - 1)
    wanted = aligned.withColumn("wl_place", F.explode(span)).join(places, ["wl_item", "wl_place"])
    wanted = checkpoint(wanted.withColumn("wl_want", F.col("wl_shift") + F.col("wl_place")))
    met = wanted.join(index.select(*KEY, "wl_pos", "wl_term"), [*KEY, "wl_term"])
    met = met.where(F.abs(F.col("wl_pos") - F.col("wl_want")) <= slop)
    rows = met.groupBy(*ALIGNED, "wl_from", "wl_length").agg(F.countDistinct("wl_place").alias("wl_near"))
    return rows.where(F.col("wl_near") >= F.least("wl_length", F.lit(near)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, its keys, ``n_words, n_hit, n_items, items`` (ids as strings, sorted).

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other
    columns are not read. Null texts have no words; items without words or id match
    nothing; items shorter than the window are one window. Rows with the same id but
    different texts are different documents; equal rows get equal results. Empty tables
    give no rows, or rows without hits.
    """
    places = item_places(items)
    index, vocabulary = build_index(docs, places)
    numbered = checkpoint(places.join(vocabulary, "wl_word").select("wl_item", "wl_place", "wl_term"))
    found = exact_matches(index, numbered, window)
    per_doc = found.groupBy(*KEY).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("wl_hits")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("wl_item.wl_item")).alias("items"),
    )
    ends = index.where(F.col("wl_term") == END).select("doc_id", *KEY, F.col("wl_pos").cast("long").alias("n_words"))
    joined = ends.join(per_doc, KEY, "left")
    no_items = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        *KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", no_items).alias("items"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of ``docs`` without documents that hold a window of an item."""
    hit = checkpoint(contamination(docs, items, window).where("n_hit > 0").select(*KEY).distinct())
    keyed = docs.select("*", *row_keys())
    return keyed.join(hit, KEY, "left_anti").drop(*KEY)


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hits of benchmark items in every document, the item ids as a digest."""
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
