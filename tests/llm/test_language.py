"""Language identification: planted languages, held-out documents, and plain versions of its parts."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.llm import language, queries

LETTERS = {"xx": "abcdefghij", "yy": "fghijklmno", "zz": "äöüßpqrstu"}


def planted(rng, lang, words):
    """Words of one language: its letters follow each other in ways of their own."""
    letters = LETTERS[lang]
    found = []
    for _ in range(words):
        at, word = rng.randrange(10), ""
        for _ in range(rng.randint(2, 9)):
            word += letters[at]
            at = (at * 3 + rng.choice([1, 2])) % 10
        found.append(word)
    return " ".join(found)


@pytest.fixture(scope="module")
def planted_docs(spark):
    rng = random.Random(9)
    rows = [(i, planted(rng, lang, rng.randint(3, 80)), lang) for i, lang in enumerate(rng.choices(["xx", "yy", "zz"], [8, 3, 1], k=400))]
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(200)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_windows_of_a_text_make_no_difference(monkeypatch):
    rng = random.Random(2)
    texts = ["", "7 !", "a", "É", " ab  cd-ef\n12 gh", "".join(rng.choice("aÄß  .9あ") for _ in range(500))]
    whole = [language.gram_counts(t) for t in texts]
    for size in (1, 2, 7):
        monkeypatch.setattr(language, "WINDOW", size)
        for text, counts in zip(texts, whole, strict=True):
            now = language.gram_counts(text)
            assert (counts is None) == (now is None) == (not any(map(str.isalpha, text)))
            assert counts is None or (counts == now).all()


def test_counts_equal_plain_grams():
    text = "Über die Brücke, 3 über den Fluß"
    plain = "  " + " ".join("".join(c if c.isalpha() else " " for c in text).lower().split()) + " "
    grams = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(3 - n, len(plain) - n + 1))
    expected = np.zeros(language.BUCKETS, int)
    for gram, n in grams.items():
        if gram != " ":
            one = np.array([ord(c) for c in gram.rjust(3, "\0")], np.uint64)[:, None]
            mix = one[2] * language.MULTIPLIERS[0]
            for k in (1, 2):
                mix = mix ^ (one[2 - k] * language.MULTIPLIERS[k] if len(gram) > k else np.uint64(0))
            mix = (mix ^ (mix >> np.uint64(29))) * language.MULTIPLIERS[1]
            expected[int(mix[0] >> np.uint64(50))] += n
    assert (language.gram_counts(text) == expected).all()


def test_frequencies_count_every_text(spark, planted_docs):
    rows, docs = planted_docs
    counts = [language.gram_counts(t) for _, t, _ in rows]
    df = sum((c > 0).astype(int) for c in counts)
    assert np.allclose(language.inverse_frequencies(docs), np.log((1 + len(rows)) / (1 + df)) + 1)


def test_planted_languages(spark, planted_docs):
    rows, docs = planted_docs
    got = {r["doc_id"]: r for r in language.language_digest(docs).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    # The layout of the table makes no difference, and held-out languages are not looked at.
    hidden = docs.withColumn("lang", F.when(language.held_out(), "yy").otherwise(F.col("lang")))
    again = {r["doc_id"]: r for r in language.language_digest(hidden.repartition(7)).collect()}
    assert again == got


def test_far_texts_are_not_accepted(spark, planted_docs):
    rows, docs = planted_docs
    model = language.learn_languages(docs)
    assert sorted(set(model.langs)) == ["xx", "yy", "zz"]
    assert all(model.langs.count(lang) > 1 for lang in LETTERS)
    own = [model.nearest(t)[2] for _, t, _ in rows]
    assert np.mean(own) > 0.98 and not any(model.nearest(t)[2] for t in ("дом на горе у реки", "wvwv vwvw wwv"))


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small[2]}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = queries.op12_language(spark, small[2]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = language.identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(rows[0].asDict())
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert r["lang_pred"] in (["en", "de"] if letters else ["und"]) and (letters or (r["score"], r["accepted"]) == (0.0, False))
    assert language.language_digest(no_docs).collect() == []
    # Nothing was learned, or only texts without a letter.
    for table in (odd_docs.withColumn("lang", F.lit(None).cast("string")), odd_docs.withColumn("text", F.lit("1 2 3"))):
        assert {r["lang_pred"] for r in language.language_digest(table).collect()} == {"und"}
    long = pd.DataFrame({"doc_id": [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:4], "text": ["ab cd " * 400_000, "xyz " * 5, "ab cd", "zyx zyx"], "lang": ["a", "b", "a", "b"]})
    assert [r["lang_pred"] for r in language.identify_languages(spark.createDataFrame(long)).orderBy("doc_id").collect()] == list("abab")
