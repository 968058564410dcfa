"""Term statistics, vocabulary and TF-IDF over a ``(doc_id, text)`` table.

``doc_id`` identifies a row: it must be unique. A document is one row, so its term
counts are worked out inside the row and need no shuffle; only per-term sums do. Where
several steps read the same counts, ``counted_documents`` writes them once; the table it
returns may stand in for the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.constants import MAX_FEATURES, MIN_DF, STOP_WORDS, TFIDF_ROWS
from wordloom.functions.text import text_halves, tokenize
from wordloom.session import checkpoint, numbered

# Decimals kept when sorting by a float score, so that the order does not depend on
# the order of summation.
SORT_DECIMALS = 9


def term_runs(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row per document with its distinct terms and counts: ``(doc_id, terms)``.

    The sorted tokens form runs of equal terms; a run's length is the term's count.
    """
    ordered = docs.select("doc_id", F.sort_array(tokens).alias("ordered"))
    starts = F.filter(
        F.transform("ordered", lambda term, i: F.when((i == 0) | (term != F.get("ordered", i - 1)), i)),
        lambda start: start.isNotNull(),
    )
    with_starts = ordered.select("doc_id", "ordered", starts.alias("starts"))
    return with_starts.select(
        "doc_id",
        F.transform(
            "starts",
            lambda start, run: F.struct(
                F.get("ordered", start).alias("term"),
                (F.coalesce(F.get("starts", run + 1), F.size("ordered")) - start).cast("long").alias("tf"),
            ),
        ).alias("terms"),
    )


def tokens(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """One row per token occurrence: ``(doc_id, pos, token)``."""
    exploded = docs.select("doc_id", F.posexplode_outer(tokenize(F.col("text"), min_token_len)).alias("pos", "token"))
    return exploded.where(F.col("token").isNotNull())


def counted(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """Documents as ``(doc_id, terms)``; tables that are already so stay as they are."""
    return docs if "text" not in docs.columns else term_runs(docs, tokenize(F.col("text"), min_token_len))


def counted_documents(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """The same as a written table."""
    return checkpoint(counted(docs, min_token_len)) if "text" in docs.columns else docs


def term_frequency(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """Count of each term in each document: ``(doc_id, term, tf)``."""
    runs = counted(docs, min_token_len)
    # The outer form, because the plain one makes Catalyst filter on the array's size
    # ahead of the projections, that is, work out the tokens twice and more. The filter is
    # on the term, as joins put it, so that plans with and without a join share a shuffle.
    exploded = runs.select("doc_id", F.explode_outer("terms").alias("t")).where(F.col("t.term").isNotNull())
    return exploded.select("doc_id", "t.term", "t.tf")


def drop_stop_words(postings: DataFrame, stop_words: list[str] | DataFrame = STOP_WORDS) -> DataFrame:
    """Postings without stop words; a table of any size (column ``word``) also serves."""
    if isinstance(stop_words, DataFrame):
        return postings.join(stop_words, postings["term"] == stop_words["word"], "left_anti")
    return postings.where(~F.col("term").isin(sorted(set(stop_words))))


def document_count(docs: DataFrame) -> Column:
    """The number of documents, empty ones included, as a scalar subquery."""
    return docs.agg(F.count(F.lit(1))).scalar()


def vocab_stats(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """Document and corpus frequency of every term: ``(term, df, cf)``."""
    return (
        term_frequency(docs, min_token_len)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def vocab_pruned(
    docs: DataFrame, min_df: float = MIN_DF, max_features: int = MAX_FEATURES, min_token_len: int = 2
) -> DataFrame:
    """Terms in at least ``min_df`` of the documents, the most frequent ``max_features``."""
    if max_features < 1:
        raise ValueError("max_features must be 1 or more")
    frequent = vocab_stats(docs, min_token_len).where(F.col("df") >= F.lit(float(min_df)) * document_count(docs))
    return frequent.orderBy(F.desc("cf"), "term").limit(max_features)


def vocab_index(vocab: DataFrame) -> DataFrame:
    """The vocabulary with alphabetical positions ``idx`` from 0."""
    return numbered(vocab, "term", "idx")


def idf_of(df: Column, documents: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.ln((F.lit(1.0) + documents) / (F.lit(1.0) + df)) + F.lit(1.0)


def term_idf(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """Smoothed inverse document frequency: ``(term, df, idf)``."""
    idf = idf_of(F.col("df"), document_count(docs))
    return vocab_stats(docs, min_token_len).select("term", "df", idf.alias("idf"))


# A term is common if it makes up at least this part of all postings. There can be no
# more than 1 / COMMON_SHARE common terms, which bounds what is sent to the tasks for them.
COMMON_SHARE = 1e-4


# Documents of a batch that are weighed at a time.
WEIGHED_DOCS = 2048


def weighed_rows(runs: DataFrame, common: dict[str, float]) -> DataFrame:
    """``(doc_id, numbers, counts, common_square, rare)``: a document's terms by whether ``common`` holds their idf.

    ``numbers`` are the places in ``common`` of the terms it holds, ``counts`` their counts,
    ``common_square`` is the sum of the squares of their weights, and ``rare`` lists the other
    terms and their counts. A batch is worked off and sent on by parts.
    """
    names, idf = list(common), np.array(list(common.values()), float)

    def part(rows: np.ndarray, size: int, held: np.ndarray, values: pa.Array) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[held], minlength=size))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = pa.array(names, pa.string())
        for whole in batches:
            for start in range(0, len(whole), WEIGHED_DOCS):
                batch = whole.slice(start, WEIGHED_DOCS)
                lists, size = batch.column("terms"), len(batch)
                postings = lists.flatten()
                terms, counts = postings.field("term"), postings.field("tf").to_numpy()
                rows = np.repeat(np.arange(size), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                found = pc.index_in(terms, value_set=lookup)
                held = found.is_valid().to_numpy(zero_copy_only=False)
                numbers = found.drop_null().to_numpy()
                weights = counts[held] * idf[numbers]
                square = np.bincount(rows[held], weights * weights, size).astype(float)
                rare = pa.StructArray.from_arrays([terms.filter(pa.array(~held)), pa.array(counts[~held])], ["term", "tf"])
                lists_of = [part(rows, size, held, pa.array(numbers.astype(np.int16))), part(rows, size, held, pa.array(counts[held]))]
                columns = [batch.column("doc_id"), *lists_of, pa.array(square), part(rows, size, ~held, rare)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "numbers", "counts", "common_square", "rare"])

    rare_type = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    schema = T.StructType(
        [
            runs.schema["doc_id"],
            T.StructField("numbers", T.ArrayType(T.ShortType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("common_square", T.DoubleType()),
            T.StructField("rare", T.ArrayType(rare_type)),
        ]
    )
    return runs.select("doc_id", "terms").mapInArrow(weigh, schema)


def doc_tfidf(docs: DataFrame, min_token_len: int = 2) -> DataFrame:
    """TF-IDF with every document scaled to unit length: ``(doc_id, term, tfidf)``.

    Terms are counted once and written. Common terms, few by definition and most of all
    postings, get their idf inside the document's row and travel as numbers. The postings of
    rare terms meet their idf in a join, where no key is busy, and come back to the row as one list.
    """
    runs = counted_documents(docs, min_token_len)
    stats = checkpoint(vocab_stats(runs).select("term", "df"))
    idf = stats.select("term", "df", idf_of(F.col("df"), document_count(runs)).alias("idf"))
    common = idf.where(F.col("df") >= F.lit(COMMON_SHARE) * stats.agg(F.sum("df")).scalar())
    known = {row["term"]: row["idf"] for row in common.collect()}
    rows = weighed_rows(runs, known)
    postings = rows.select("doc_id", F.explode("rare").alias("t")).select("doc_id", "t.term", "t.tf")
    weights = postings.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    rare = weights.groupBy("doc_id").agg(
        F.collect_list(F.struct("term", "w")).alias("rare"), F.sum(F.col("w") * F.col("w")).alias("rare_square")
    )
    whole = rows.select("doc_id", "numbers", "counts", "common_square").join(rare, "doc_id", "left")
    norm = F.sqrt(F.col("common_square") + F.coalesce("rare_square", F.lit(0.0)))

    def entry(number: Column | None, tf: Column | None, term: Column | None, w: Column | None) -> Column:
        kinds = {"number": (number, "smallint"), "tf": (tf, "long"), "term": (term, "string"), "w": (w, "double")}
        return F.struct(*[(F.lit(None) if value is None else value).cast(kind).alias(name) for name, (value, kind) in kinds.items()])

    common_terms = F.transform("numbers", lambda n, i: entry(n, F.get("counts", i), None, None))
    rare_terms = F.transform("rare", lambda t: entry(None, None, t["term"], t["w"]))
    terms = F.concat(common_terms, F.coalesce(rare_terms, F.slice(common_terms, 1, 0)))
    exploded = whole.select("doc_id", norm.alias("norm"), F.explode(terms).alias("t"))
    # The common terms and their idf in order of their numbers: one row, as long as there can be common terms.
    listed = runs.sparkSession.createDataFrame([(list(known), list(known.values()))], "terms array<string>, idf array<double>")
    term = F.coalesce("t.term", F.get(listed.select("terms").scalar(), F.col("t.number").cast("int")))
    w = F.coalesce("t.w", F.col("t.tf") * F.get(listed.select("idf").scalar(), F.col("t.number").cast("int")))
    return exploded.select("doc_id", term.alias("term"), (w / F.col("norm")).alias("tfidf"))


def tfidf_table(docs: DataFrame, rows: int = TFIDF_ROWS, min_token_len: int = 2) -> DataFrame:
    """The terms with the highest TF-IDF sums: ``(term, score)``, best first."""
    sums = doc_tfidf(docs, min_token_len).groupBy("term").agg(F.sum("tfidf").alias("score"))
    return sums.orderBy(F.desc(F.round("score", SORT_DECIMALS)), "term").limit(rows)


def tfidf_json(table: DataFrame) -> DataFrame:
    """A keyword table of at most a few hundred rows as one JSON object, best first."""
    entry = F.struct(F.round("score", SORT_DECIMALS).alias("rank"), "term", "score")
    ordered = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["rank"] > b["rank"], -1)
        .when(a["rank"] < b["rank"], 1)
        .when(a["term"] < b["term"], -1)
        .when(a["term"] > b["term"], 1)
        .otherwise(0),
    )
    scores = F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["term"], e["score"])))
    return table.agg(F.to_json(F.struct(scores.alias("TF-IDF"))).alias("json"))


def split_single_document(docs: DataFrame) -> DataFrame:
    """If the corpus is one document, its two halves as two documents; else the corpus.

    The halves get the ids ``0`` and ``1``, in the type that ``doc_id`` has.
    """
    single = document_count(docs) == 1
    kind = docs.schema["doc_id"].dataType
    parts = F.when(single, text_halves(F.col("text"))).otherwise(F.array("text"))
    return docs.select("doc_id", F.posexplode_outer(parts).alias("half", "text")).select(
        F.when(single, F.col("half").cast(kind)).otherwise(F.col("doc_id")).alias("doc_id"), "text"
    )


def lookup_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Whether each distinct ``word`` is in ``dictionary``: ``(word, found)``."""
    known = dictionary.select("word").distinct().withColumn("found", F.lit(True))
    return (
        words.select("word").distinct().join(known, "word", "left")
        .select("word", F.coalesce("found", F.lit(False)).alias("found"))
    )


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Distinct words that are not in ``dictionary``."""
    return words.select("word").distinct().join(dictionary, "word", "left_anti")
