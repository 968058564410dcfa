"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from wordloom.llm import queries, spelling


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point tells two words apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    found = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return found


def digest_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_pivots_are_the_lightest_that_do_not_overlap():
    rng = random.Random(1)
    for _ in range(300):
        grams = [(place, rng.randint(1, 9)) for place in sorted(rng.sample(range(12), 3))]
        ways = [(x[1] + y[1], x[0], y[0]) for x in grams for y in grams if y[0] - x[0] >= 2]
        found = spelling.pivots(grams)
        assert (sum(w for p, w in grams if p in found), len(found)) == (min(ways)[0], 2)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "eé×÷"])
def test_near_words_equal_brute(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(150)}
    for word in list(words):
        at, new = rng.randrange(len(word) + 1), rng.choice(letters)
        words |= {word[:at] + new + word[at:], word[:at] + new + word[at + 1 :]}
    words |= {letters[0] * n for n in range(7, 60)} | {"q" * 40 + letters[0] * n + "z" * 40 for n in range(5)}
    counts = {w: rng.choice([2, 3, 20, 30, 250, 3000]) for w in words if len(w) >= 7}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(table).collect()}
    assert got == variants(counts)


def test_chains_of_forms_and_ties(spark):
    counts = {"abcdefg": 100_000, "abcdefh": 2_000, "abcdeih": 150, "abcjeih": 15, "zzzzzzz": 20, "zzzzzzy": 20, "zzzzzzx": 2}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(table).collect()}
    assert got == variants(counts)
    assert got["abcjeih"][1] == "abcdefg" and got["zzzzzzx"][0] == "zzzzzzy"
    with pytest.raises(ValueError):
        spelling.spelling_variants(table, ratio=1)


def test_digest_of_given_documents(spark, small, duck):
    got = {r["word"]: tuple(r)[1:] for r in queries.op13_spelling(spark, small[2]).collect()}
    assert set(got) == set(digest_words(small[1])) and {w: x[2] for w, x in got.items()} == digest_words(small[1])
    rows = duck.execute(queries.ORACLE["op13_spelling"]).fetchall()
    assert {r[0]: r[1:] for r in rows} == got


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    long = "ab" * 60_000
    more = spark.createDataFrame([(90, f"{long} {long}x"), (91, f"{long} {long}x {long}")], "doc_id long, text string")
    rows += [(r["doc_id"], r["text"]) for r in more.collect()]
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_digest(docs).collect()}
    assert got == variants(digest_words(rows))
    assert spelling.spelling_digest(odd_docs.withColumn("word", odd_docs["text"]).withColumn("wl_run", odd_docs["text"])).count() > 0
    assert spelling.spelling_digest(no_docs).collect() == []
