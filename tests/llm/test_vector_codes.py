"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import queries, vector_codes


def plain_codes(rows, rounds=6, parts=8, entries=16):
    """vec_id: (code, error, label_error), and the digest, by full scans over Python integers."""
    kept = []
    for vec_id, label, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(Fraction(float(x)) * 4096) for x in v]
            width = len(whole) // parts
            kept.append((vec_id, label, [whole[p * width : (p + 1) * width] for p in range(parts)]))
    kept.sort(key=lambda row: row[0])
    books = [[row[2][p] for row in kept[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [assign(p, row[2][p])[1] for row in kept]
            for e in range(len(books[p])):
                own = [row[2][p] for row, k in zip(kept, of, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(row[0], row[1], [assign(p, row[2][p]) for p in range(parts)]) for row in kept]
    of_label = {}
    for _, label, near in found:
        of_label[label] = of_label.get(label, 0) + sum(d for d, _ in near)
    codes = {i: ("".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), of_label[label]) for i, label, near in found}
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return codes, hashlib.sha256(flat.encode()).hexdigest()


def digest(df):
    rows = vector_codes.codes_digest(df).collect()
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in rows}, {r["codebooks_sha256"] for r in rows}


def test_active_scan_equals_full_scan():
    """Small whole numbers, so that many distances tie."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        points, entries = rng.integers(-2, 3, (60, 2)), rng.integers(-2, 3, (7, 2))
        near, apart = vector_codes.full_scan(points, entries)
        after = np.where(rng.random((7, 1)) < rng.choice([0, 0.3, 1]), entries + rng.integers(-1, 2, (7, 2)), entries)
        found = vector_codes.active_scan(points, after, (after != entries).any(axis=1), near, apart)
        assert all((x == y).all() for x, y in zip(found, vector_codes.full_scan(points, after), strict=True))


def test_given_vectors_equal_brute_and_sql(spark, small, duck):
    table = spark.read.parquet(f"{small[2]}/embeddings.parquet")
    got = digest(table.repartition(5))
    codes, books = plain_codes([(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()])
    assert got == (codes, {books})
    rows = duck.execute(queries.ORACLE["op11_vector_codes"]).fetchall()
    assert {r[0]: r[1:4] for r in rows} == codes and {r[4] for r in rows} == {books}


@pytest.mark.parametrize("step", [1, 2**-14, 300])
def test_ties_and_negative_components(spark, monkeypatch, step):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), [float(rng.randint(-2, 2) * step) for _ in range(16)]) for i in range(0, 1500, 5)]
    rows += [(i + 1, label, v) for i, label, v in rows[:100]]
    monkeypatch.setattr(vector_codes, "BLOCK", 16 * 7)
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    codes, books = plain_codes(rows)
    assert digest(table) == (codes, {books})


def test_odd_vectors(spark, monkeypatch):
    good = [(i, i % 2, [float((i * k) % 5) for k in range(8)]) for i in range(9)]
    odd = [None, [], [None] * 8, [1.0] * 7 + [float("nan")], [float("inf")] * 8, [0.0] * 7 + [None]]
    rows = good + [(100 + i, 0, v) for i, v in enumerate(odd)] + [(50, None, [0.0] * 8), (51, None, [1e300] * 8)]
    schema = "vec_id long, label int, embedding array<double>"
    names = {name: F.lit("x") for name in ("code", "wl_v", "wl_label", "wl_near", "error", "label_error")}
    table = spark.createDataFrame(rows, schema).withColumns(names)
    got, _ = digest(table)
    assert set(got) == {*range(9), 50, 51}
    wide = [(i, label, [min(x, 2.0**14) for x in v]) for i, label, v in rows if i in got]
    assert got == plain_codes(wide)[0]
    # Other lengths than the smallest id's are no vectors of the table; a null id comes last.
    more = spark.createDataFrame([(60, 0, [1.0] * 16), (61, 0, [1.0] * 9), (None, 1, [3.0] * 8), (3, 1, good[3][2])], schema)
    again = vector_codes.codes_digest(table.select("vec_id", "label", "embedding").unionByName(more)).collect()
    assert sorted(str(r["vec_id"]) for r in again) == sorted(map(str, [*got, 3, None]))
    empty = vector_codes.codes_digest(table.where("false"))
    assert empty.collect() == [] and empty.columns == vector_codes.codes_digest(table).columns
    assert vector_codes.codes_digest(table.where("vec_id > 99")).collect() == []


def test_codes_stand_for_near_vectors(spark, small):
    table = spark.read.parquet(f"{small[2]}/embeddings.parquet")
    found = vector_codes.vector_codes(table)
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect() if r["embedding"]}
    for row in found.rows.limit(20).collect():
        back = vector_codes.decoded(bytes(row["code"]), found.books)
        apart = ((np.floor(np.array(vectors[row["vec_id"]]) * 4096) - back * 4096) ** 2).sum()
        assert int(apart) == row["error"]
    with pytest.raises(ValueError):
        vector_codes.vector_codes(table, entries=300)
