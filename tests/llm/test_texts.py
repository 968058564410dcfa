"""Operators that look at one text at a time: personal data, licenses, quality."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import licenses, pii, quality


def test_pii_base_equals_brute(small, odd_docs):
    docs, rows, _ = small
    for table, expected in ((docs, rows), (odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])):
        found = sorted(map(tuple, pii.pii_digest(table).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)
        wanted = []
        for doc, text in expected:
            spans = brute.base_spans(text)
            wanted.append((doc, *[sum(s[1] == k for s in spans) for k in range(4)], brute.sha(brute.written(spans))))
        assert found == sorted(wanted, key=str)


def test_pii_on_hard_texts(spark):
    rng = random.Random(1)
    pieces = ["a@b.c", "_x@y.z", "@", "..", "1.2.3.4", ".5.6.7.8", "4111111111111111", " 1", "-2", "+1", "(555)", "é", "😀", "x", " ", "%", "0.0.0.0", "+49 30 123456"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["a" * 50_000 + "@b.c", "1" * 30_000, "7 " * 20_000, "a@b" + ".c" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.pii_digest(docs).collect()}
    assert got == {i: brute.sha(brute.written(brute.base_spans(t))) for i, t in enumerate(texts)}


def test_pii_checksums_and_context(spark):
    texts = ["iban GB82WEST12345698765432 ok", "GB82WEST12345698765433", "ssn 123-45-6789", "row 123-45-6789 of it", "x@y.z " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_digest(docs).collect()}
    assert [spans[i] for i in range(4)] == ["iban:5:27", "", "ssn:4:15", ""]
    assert spans[4] == ",".join(f"email:{6 * i}:{6 * i + 5}" for i in range(500))
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert masked[0] == "iban <iban> ok" and masked[3] == texts[3]


def test_license_base_equals_brute(small, odd_docs):
    docs, rows, _ = small
    for table, expected in ((docs, rows), (odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])):
        found = licenses.license_digest(table).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        assert sorted(map(tuple, found), key=str) == sorted(((d, *brute.license_base(t)) for d, t in expected), key=str)


def plain_scan(text):
    """All rules without gates, each detection against each other."""
    low = text.encode().translate(licenses.LOWER_ONLY)
    found = [(m.start(), m.end(), rule) for rule in licenses.rules() for m in rule.pattern.finditer(low)]
    kept = []
    for i, (s, e, rule) in enumerate(found):
        inside = lambda o: o[0] <= s and o[1] >= e and o[2].priority >= rule.priority  # noqa: B023, E731
        better = [o for j, o in enumerate(found) if j != i and inside(o) and ((o[0], o[1], o[2].priority) != (s, e, rule.priority) or o[2].label < rule.label)]
        if not better:
            kept.append((rule.label, s, e))
    return set(kept)


def test_license_rules_equal_plain_scan():
    rng = random.Random(2)
    names = ["Apache License", "MIT License", "version 2.0", "GNU", "Lesser", "General Public License", "v3", "Licensed under the", "CC BY-NC", "4.0", "Creative Commons Attribution", "ShareAlike", "SPDX-License-Identifier:", "MIT", "https://www.apache.org/licenses/LICENSE-2.0", "BSD 3-Clause", "license:", "0BSD", "cc0 1.0", "MIT No Attribution"]
    for _ in range(150):
        text = " ".join(rng.choice(names) for _ in range(rng.randint(1, 8)))
        assert {(d[0], d[2], d[3]) for d in licenses.scan_text(text)[5]} == plain_scan(text), text


def test_licenses_number_of_rules_and_gates():
    assert len(licenses.rules()) > 300
    for rule in licenses.rules():
        padded = b" " + rule.keyword + b" "
        assert any(stem in padded for stem in licenses.STEMS) or rule.template == "address" or b"licen" in rule.pattern.pattern


def test_quality_on_planted_junk(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        good = i % 4 != 0
        listed = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(listed).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in listed)))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(9000, None), (9001, ""), (9002, "x"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    marked = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, marked)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: i % 4 != 0 for i in range(900)}
    unseen = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([(r["predicted"] == 1) == truth[r["doc_id"]] for r in unseen]) > 0.98
    again = {(r["doc_id"], r["score"]) for r in quality.score_quality(docs, marked).collect()}
    assert max(abs(a[1] - b[1]) for a, b in zip(sorted(again), sorted({(r["doc_id"], r["score"]) for r in got}), strict=True)) < 1e-3


def test_quality_without_labels_or_documents(no_docs, odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_digest(no_docs, none).count() == 0
    assert {r["score"] for r in quality.quality_digest(odd_docs, none).collect()} == {0.5}


def test_held_out_accuracy(small, spark):
    docs, _, folder = small
    marked = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality_digest(docs, marked).join(marked, "doc_id").where("held_out").collect()
    assert np.mean([(r["predicted"] == r["quality"]) for r in got]) > 0.9


@pytest.mark.parametrize("operator", [pii.find_pii, licenses.scan_licenses])
def test_columns_and_empty_tables(operator, odd_docs, no_docs):
    added = "pii" if operator is pii.find_pii else "license"
    assert [c for c in operator(odd_docs).columns if c != added] == [c for c in odd_docs.columns if c != added]
    assert operator(odd_docs).count() == odd_docs.count()
    assert operator(no_docs).count() == 0


def test_words_of_units_agree():
    ids, shapes = quality.units("Ab cd  CD cd cd!\n", quality.ShapeIds())
    assert len(ids) == len(shapes) == 5 and shapes[4] != quality.REPEAT
    assert quality.units("cd cd", quality.ShapeIds())[1][1] == quality.REPEAT
    assert re.match("a", "a") and len(quality.units("é É", quality.ShapeIds())[0]) == 2


def test_account_numbers_end_after_their_length(spark):
    """Capitals and digits that follow a number do not hide it, other than those that touch it."""
    texts = [
        "BE71 0961 2345 6769 EUR 5",
        "pay BE71 0961 2345 6769 PAID",
        "BE71 0961 2345 6769 now",
        "DE89370400440532013000 AB12",
        "BE71 0961 2345 6769EUR",
        "FR14 2004 1010 0505 0001 3M02 606 X",
        "bank ZZ82 WEST 1234 5698 7654 32",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.pii_digest(docs).collect()}
    spans = {i: x for i, (x, _) in found.items()}
    assert [spans[i] for i in range(4)] == ["iban:0:19", "iban:4:23", "iban:0:19", "iban:0:22"]
    assert spans[4] == "" and spans[5] == "iban:0:33"
    assert found[0][1] == "0.8" and found[1][1] == "0.8"
    with_context = spark.createDataFrame([(1, "my bank BE71 0961 2345 6769 x a@b.c")], "doc_id long, text string")
    assert pii.pii_digest(with_context).first()["scores"] == "1.0,0.8"


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal in the Software."""
BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived."""


@pytest.mark.parametrize("text,labels", [
    (MIT_BODY, ["mit"]),
    (BSD_BODY, ["bsd", "bsd-3-clause"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    ("License: MIT", ["mit"]),
    ("It is licensed under MIT.", ["mit"]),
    ("GPLv2", ["gpl-2.0"]),
    ("use GPLv3+ here", ["gpl-3.0"]),
    ("LGPL-2.1", ["lgpl-2.1"]),
    ("MPL 2.0", ["mpl-2.0"]),
    ("Apache-2.0", ["apache-2.0"]),
    ("BSD-3-Clause", ["bsd-3-clause"]),
    ("GNU GPL v3", ["gpl-3.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["apache-2.0", "mit"]),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause", ["bsd-3-clause", "gpl-2.0"]),
    ("the apache people met 2 of 3 gpl fans; submit 20 epl forms under review", []),
    ("mitigate the mit campus license plates", []),
])
def test_signatures(text, labels):
    *_, detections, score = licenses.scan_text(text)
    assert sorted({d[0] for d in detections}) == labels
    assert (score > 0.5) == bool(labels)
