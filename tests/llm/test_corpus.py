"""Operators over the whole corpus, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from wordloom.llm import components, decontaminate, lattice_dedup, minhash, mixing, sharding, shingles, suffix_dedup, suffixes


def test_shingles_and_signatures():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    for n in (0, 1, 4, 5, 6, 300):
        text = " ".join(rng.choice(words) for _ in range(n))
        assert len(shingles.shingle_set(text)) == len(brute.shingles(text))
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:340], np.random.default_rng(2).integers(0, 1 << 63, 60).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((shingles.signature(a) == shingles.signature(b)).mean() - true) < 0.12


def near_copies(rng, n):
    """Groups of near copies around the limit, chains, copies and odd texts."""
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c d e"), (5, "a b c d e f")]
    for _ in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 45))):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.4:
                base = copy
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], text) for i, (_, text) in enumerate(rows)]


def test_near_duplicates_equal_brute(spark, small):
    for rows in (near_copies(random.Random(5), 60), small[1]):
        docs = spark.createDataFrame([(int(d), t) for d, t in rows], "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
        assert got == brute.near_duplicates(rows)


def test_rest_of_buckets_is_searched(spark, monkeypatch):
    """Links that no star shows: the hub of every bucket is far from two members that are close."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in rng.sample(range(0, 200, 8), 5):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 7)
    for percent in (60, 70, 78):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent).collect()}
        sets = {d: brute.shingles(t) for d, t in rows}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert got == brute.components(sets, links)


def test_only_rows_of_open_buckets_meet_their_sketches(spark, monkeypatch):
    """Buckets of one component drop out before anything is joined; the others are dealt to pairs of blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rows = [(1, 0, n, 7) for n in range(20)] + [(2, 1, n, n % 2) for n in range(3)]
    members = spark.createDataFrame(rows, "wl_bucket long, wl_band int, wl_node long, component long")
    got = minhash.open_members(members).collect()
    assert {r["wl_bucket"] for r in got} == {2} and len(got) == 3 * 2 and all(r["wl_i"] <= r["wl_j"] for r in got)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert by_id[None] == {(None, False)} and by_id[7] == {(6, False)} and by_id[6] == {(6, True)} and by_id[5] == {(4, False)}
    assert len(by_id[3]) == 1
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).columns == no_docs.columns
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 0, 1, 2, 3, 4, 6, 8, 9, 10, 11]))


def test_components_equal_brute(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == brute.components({x for link in real for x in link}, real)


def test_contamination_equals_brute(spark, small, odd_docs, no_docs):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "One two"), (3, None), (4, ""), (5, "a b c d e f g h i j k"), (5, "from the angry bear"), (10, "b a b a b a b a b a b a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small[2]}/benchmark.parquet").collect()]
    cases = (
        (odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], table, items),
        (small[0], small[1], spark.createDataFrame(bench, "item_id long, text string"), bench),
    )
    for docs, rows, held, listed in cases:
        got = decontaminate.contamination_digest(docs, held).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute.contamination(rows, listed), key=str)
    assert decontaminate.contamination_digest(no_docs, table).count() == 0
    none = table.where("false")
    assert {r["n_hit"] for r in decontaminate.contamination_digest(odd_docs, none).collect()} == {0}
    assert decontaminate.remove_contaminated(odd_docs, table).columns == odd_docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one two three extra four five six seven eight nine ten y"), (2, "ten nine eight seven six five four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    places = decontaminate.item_places(items)
    index, vocabulary = decontaminate.build_index(docs, places)
    numbered = places.join(vocabulary, "wl_word").select("wl_item", "wl_place", "wl_term")
    assert decontaminate.exact_matches(index, numbered).count() == 0
    found = decontaminate.proximity_matches(index, numbered).collect()
    assert len(found) == 1 and found[0]["wl_near"] == 10


def test_suffix_kernels_equal_brute():
    rng = random.Random(3)
    for trial in range(6):
        pool = "".join(rng.choice("abcdefgh ") for _ in range(2000))
        texts = []
        for _ in range(40):
            text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 400)))
            if rng.random() < 0.7:
                at = rng.randint(0, 1700)
                text += pool[at : at + rng.randint(150, 400)] + text[: rng.randint(0, 300)]
            texts.append(text)
        entries = [suffixes.entry(t.encode(), p, lo, hi, g, False, (i, p)) for i, t in enumerate(texts) for p, lo, hi, g, _ in zip(*(x.tolist() for x in suffixes.anchors(t.encode())), strict=True)]
        runs = [suffixes.unpacked_run(suffixes.packed_run(entries[k::3])) for k in range(3)]
        merged = list(suffixes.merged(runs))
        listed = [e.suffix for _, e in merged]
        assert listed == sorted(e.suffix for e in entries)
        assert all(n == suffixes.common(a, e.suffix) for a, (n, e) in zip(listed, merged[1:], strict=False))
        for limit in (0, 12):
            suffixes.PAIRWISE = limit
            starts = {}
            for group in suffixes.by_gram(merged):
                for e, low, high in suffixes.repeated_starts(group):
                    i, p = e.owner
                    starts.setdefault(i, []).append((p - high, p - low))
            rows = []
            for i, t in enumerate(texts):
                gone, spans, kept = suffixes.removed(t.encode(), starts.get(i, []))
                rows.append((i, len(t), gone, spans, hashlib.sha256(kept).hexdigest()))
            assert rows == brute.repeats(list(enumerate(texts))), (trial, limit)


def test_repeats_equal_brute(spark, small, odd_docs, no_docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(tuple, suffix_dedup.suffix_digest(odd_docs).collect()), key=str)
    assert got == sorted(brute.repeats(rows), key=str)
    assert suffix_dedup.suffix_digest(no_docs).count() == 0
    expected = sorted(brute.repeats(small[1]))
    assert sorted(map(tuple, suffix_dedup.suffix_digest(small[0]).collect())) == expected
    monkeypatch.setattr(suffix_dedup, "GRAM_ENTRIES", 1)  # every gram is a busy one
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (50, 1))
    assert sorted(map(tuple, suffix_dedup.suffix_digest(small[0]).collect())) == expected


def test_mixing(spark, small, odd_docs, no_docs):
    for docs in (small[0], odd_docs):
        got = mixing.mixing_digest(docs).collect()
        assert len(got) == docs.count()
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        source = {r["doc_id"]: r["source"] for r in docs.collect() if r["doc_id"] is not None}
        sums, sizes, targets = Counter(), {}, {}
        for r in got:
            if r["doc_id"] is not None and r["doc_id"] != 3:
                name = source[r["doc_id"]]
                sizes[name], targets[name] = r["source_size"], r["target"]
        for r in got:
            key = next((k for k in sizes if (sizes[k], targets[k]) == (r["source_size"], r["target"])), None)
            sums[key] += r["taken"]
        assert all(abs(sums[k] - targets[k]) <= 1 for k in targets)
        assert sorted(map(tuple, mixing.mixing_digest(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixing_digest(no_docs).count() == 0
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1, 1000], [0, 5, 500, 7], [0, 0], [1, 1_000_000, 3, 40, 5]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    weight, total = [i % 3 + 1 for i in range(len(sizes))], sum(sizes)
    capped, target = set(), [0.0] * len(sizes)
    while total:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        target = [3.0 * sizes[i] if i in capped else left * weight[i] / sum(weight[k] for k in free) for i in range(len(sizes))]
        above = {i for i in free if target[i] > 3 * sizes[i] + 1e-9}
        if not above:
            break
        capped |= above
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(target)


def test_schedule_is_even(spark):
    table = spark.createDataFrame([("a", 6000), ("b", 6000), ("c", 6000)], "source string, source_size long")
    slots = mixing.schedule(mixing.source_targets(table), 18_000, 10).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1800))
    seen = Counter()
    for i, r in enumerate(slots):
        assert r["wl_block"] == seen[r["wl_source"]]
        seen[r["wl_source"]] += 1
        assert all(abs(seen[s] - (i + 1) * (s + 1) / 6) < 4 for s in range(3))


def test_sharding(spark, small, odd_docs, no_docs):
    for docs in (small[0], odd_docs):
        got = sharding.sharding_digest(docs).collect()
        assert len(got) == docs.count()
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
        for shard, n in counts.items():
            assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    texts = dict(small[1])
    for r in sharding.sharding_digest(small[0]).collect():
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16
    many = sharding.shuffle_into_shards(small[0], shards=7, bucket_bytes=5_000).collect()
    assert sorted(r["doc_id"] for r in many) == sorted(texts)
    assert sharding.sharding_digest(no_docs).count() == 0


def test_written_shards(small, tmp_path, spark):
    sharding.write_shards(sharding.shuffle_into_shards(small[0], shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == sorted(d for d, _ in small[1])
    one = [r["slot"] for r in spark.read.parquet(str(tmp_path / "out" / "shard=2")).collect()]
    assert one == list(range(len(one)))


def test_vector_links_equal_brute(spark):
    rng = np.random.default_rng(7)
    rows, dims = [], 24
    for centre in rng.normal(size=(12, dims)):
        for spread in rng.choice([0.02, 0.08, 0.14], rng.integers(1, 25)):
            rows.append((centre + spread * np.linalg.norm(centre) * rng.normal(size=dims)).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [], [1.0, 2.0]]
    ids = rng.permutation(len(rows)).tolist()
    table = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.vector_links(table).collect()}
    good = [(i, np.array(v)) for i, v in zip(ids, rows, strict=True) if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == dims]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9]
    label = brute.components(ids, links)
    n = Counter(x for link in links for x in link)
    missed = [i for i in ids if got[i] != (n[i], label[i], label[i] == i)]
    assert sum(got[i][0] for i in ids) >= 0.99 * 2 * len(links) and len(missed) <= 0.02 * len(ids)
    assert all(got[i][0] <= n[i] for i in ids)
    assert lattice_dedup.vector_links(table.where("false")).count() == 0


def test_vectors_with_odd_ids(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (2, [5.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in lattice_dedup.vector_links(table).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (2, 2, 1, False)], key=str)
