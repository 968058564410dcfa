"""Cases that earlier versions of the training-data operators left out."""

import math
import random
from collections import Counter

import brute
import pandas as pd
import pytest

from wordloom.llm import decontaminate, interpolated, mixing, queries


def test_documents_that_start_in_the_middle_of_an_item(spark):
    item = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(item[20:])), (2, " ".join(item[30:] + ["x"] * 50)), (3, " ".join(item[31:])), (4, " ".join(["x"] * 3 + item[25:36])), (5, " ".join(item[5:9]))]
    items = [(1, " ".join(item))]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination_digest(docs, held).collect())
    assert got == sorted(brute.contamination(rows, items))
    assert [r[2] for r in got] == [20, 10, 0, 11, 0]
    assert sorted(r["doc_id"] for r in decontaminate.remove_contaminated(docs, held).collect()) == [3, 5]


def test_each_text_is_split_once(spark, monkeypatch):
    plans, write = [], decontaminate.checkpoint
    monkeypatch.setattr(decontaminate, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    docs, held = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    decontaminate.build_index(docs, decontaminate.item_places(held))
    index = next(plan for plan in plans if "doc_id" in plan)
    assert index.count("coalesce(text") == 1


def test_words_at_the_ends_letters_beyond_ascii_and_items_beyond_64_words(spark):
    long = [f"w{i % 64}" for i in range(150)]
    items = [(1, " ".join(long)), (2, "École ÉCOLE İ ß Σ a1B"), (3, "x"), (4, "[x_y]"), (5, "\x7fnul\x00byte\x7f")]
    texts = ["x", ".x.", "École ÉCOLE İ ß Σ A1b", "école école i ß σ a1b", "X\nY", "...", "nul byte", " ".join(long[60:80]), " ".join(long[64:73] + ["w0"]), " ".join(long[3:9] + long[73:80])]
    rows = list(enumerate([*texts, None, "", "a x" * 90]))
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination_digest(docs, held).collect()))
    assert got == sorted(brute.contamination(rows, items))


@pytest.mark.parametrize("bits", [0, 20])
def test_only_marked_postings_are_shuffled_and_shared_buckets_lose_none(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BUCKET_BITS", bits)
    item = [f"w{i}" for i in range(12)]
    items, rows = [(1, " ".join(item))], [(i, " ".join(["w3"] * 40 * i + item[: 8 + i] + ["w5"] * 300)) for i in range(6)]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    result = decontaminate.contamination_digest(docs, held)
    assert "LeftSemi" in result._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, result.collect())) == sorted(brute.contamination(rows, items))


def interpolated_differences(rows, good):
    """doc_id: (n_tokens, mean of target loss less background loss) by plain counting, no word or pair left out."""
    split = {d: interpolated.lowered_words(interpolated.packed.func(pd.Series([t]))[0]) for d, t in rows}
    kinds = len({w for ws in split.values() for w in ws})
    models = []
    for ids in (list(split), [d for d in split if d in good]):
        one, two, context = Counter(), Counter(), Counter()
        for d in ids:
            one.update(split[d])
            two.update(zip(split[d], split[d][1:], strict=False))
            context.update(split[d][:-1])
        models.append((one, two, context, one.total()))

    def loss(model, before, word):
        one, two, context, total = model
        share = (one[word] + 0.5) / (total + 0.5 * kinds)
        return -math.log(share if before is None else (two[before, word] + 2.0 * share) / (context[before] + 2.0))

    background, target = models
    return {d: (len(ws), sum(loss(target, v, w) - loss(background, v, w) for v, w in zip([None, *ws], ws, strict=False)) / len(ws) if ws else None) for d, ws in split.items()}


def test_lm_scores_keep_every_word(spark, small, odd_docs, no_docs):
    good = {d for d, _ in small[1] if d % 3 == 0}
    marks = spark.createDataFrame([(int(d),) for d in good] + [(None,), (0,)], "doc_id long")
    expected = interpolated_differences(small[1], good | {0})
    # Share 1: no word is common, all are scored by hash; 2 ** -7: some are, with common pairs and contexts.
    for share, part in ((1.0, 3_000), (2.0**-7, 5_000), (2.0**-16, 1_000_000)):
        got = {r["doc_id"]: (r["n_tokens"], r["difference"]) for r in interpolated.score_documents(small[0], marks, part, share).collect()}
        assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in expected.items()}
        assert all(x[1] == pytest.approx(expected[d][1], abs=1e-9) for d, x in got.items())
    odd = interpolated.score_documents(odd_docs, marks).collect()
    assert len(odd) == odd_docs.count() and all((r["difference"] is None) == (r["n_tokens"] == 0) for r in odd)
    assert interpolated.score_documents(no_docs, marks).count() == 0
    assert interpolated.score_documents(small[0], marks.where("false")).count() == len(small[1])


def test_vocabulary_grows_with_the_corpus(spark):
    """Past 65,536 words, words rarer than those keep their counts."""
    common = [" ".join(f"c{i}" for i in range(k, k + 1000)) for k in range(0, 70_000, 1000)] * 3
    rows = [*enumerate(common), (210, "r1 x r1"), (211, "r2 y r2")]
    labels = spark.createDataFrame([(d, 1) for d in [*range(70), 210]], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["difference"] for r in queries.lm_digest(docs, labels).collect()}
    assert got[210] < got[211] - 1


def test_pairs_that_the_target_lacks_count(spark):
    """The same words, each as common in the target: only pairs that good documents do not hold tell junk."""
    good, junk = "a b c d e f", "f d b e c a"
    rows = [(i, good) for i in range(20)] + [(i, junk) for i in range(20, 60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in queries.lm_digest(docs, labels).collect()}
    assert got[0] == got[19] and got[20] == got[59] and got[0] < 0 and got[20] > 1


def test_postings_travel_once_and_texts_not_at_all(spark, small):
    """Each word of a run stands in one posting, each document's end in another; marking moves no text."""
    codes = [interpolated.HASHED | pd.Series(ws, dtype="uint64").to_numpy() for ws in ([5, 3, 5, 3, 5], [], [3], [7, 5, 3])]
    w, v, all_, good, place = interpolated.run_postings(codes, [1, 0, 0, 1])
    assert len(place) == all_.sum() == 9 + 3 and good.sum() == 8 + 2
    blocks = list(interpolated.in_parts(4, w, v, all_, good, place))
    assert sum(b[1] for b in blocks) == len(w) and sum(b[3] for b in blocks) == 12 and len({b[0] for b in blocks}) == len(blocks)
    marked = interpolated.marked_texts(small[0], spark.createDataFrame([(3,), (3,), (None,)], "doc_id long"))
    assert [r["doc_id"] for r in marked.where("wl_mark = 1").collect()] == [3] and marked.count() == len(small[1])
    assert "SortMergeJoin" not in marked._jdf.queryExecution().toString()


def test_the_mix_is_what_the_schedule_holds(spark, small, duck, monkeypatch):
    """Slots follow each other without gaps, every word taken has one, and without a schedule nothing is taken."""
    pieces = mixing.mix_blocks(small[0].select("doc_id", "text", "source")).where("words > 0").collect()
    slots = {}
    for r in pieces:
        assert slots.setdefault(r["slot"], (r["wl_source"], r["wl_block"])) == (r["wl_source"], r["wl_block"])
    assert sorted(slots) == list(range(len(slots)))
    blocks = {}
    for slot in sorted(slots):
        source, block = slots[slot]
        assert block == blocks.get(source, 0)
        blocks[source] = block + 1
    got = {tuple(r) for r in mixing.mixing_digest(small[0]).select("doc_id", "taken", "first_slot", "n_pieces").collect()}
    rows = duck.execute(f"select doc_id, taken, first_slot, n_pieces from ({queries.ORACLE['op6_mixing']})").fetchall()
    assert got == set(rows)
    # Rows of the pipeline's stage stand in the order of the slots they start in.
    first = {d: slot for d, _, slot, _ in got}
    order = [first[r["doc_id"]] for r in mixing.mix_documents(small[0]).dropDuplicates(["doc_id"]).collect() if r["doc_id"] in first]
    assert set(order) <= {slot for _, _, slot, _ in got if slot is not None}
    listed, seen = [r["doc_id"] for r in mixing.mix_documents(small[0]).collect()], set()
    starts = [first[d] for d in listed if not (d in seen or seen.add(d))]
    assert starts == sorted(starts)
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *args: whole(*args).where("false"))
    assert {r["taken"] for r in mixing.mixing_digest(small[0]).collect()} == {0}
    assert mixing.mix_documents(small[0]).count() == 0


@pytest.mark.parametrize("sizes", [[7], [3, 1_000_000], [64, 64, 65, 1], [1] * 50, [5_000, 1, 90_000, 300, 0]])
def test_every_block_has_a_slot(spark, sizes):
    table = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    targets = mixing.source_targets(table)
    need = {r["wl_source"]: math.ceil(round(r["target"]) / 64) for r in targets.collect()}
    got = mixing.schedule(targets, sum(sizes)).collect()
    assert sorted(r["slot"] for r in got) == list(range(sum(need.values())))
    assert {(r["wl_source"], r["wl_block"]) for r in got} == {(s, b) for s, n in need.items() for b in range(n)}


def test_no_plan_of_the_mix_repeats_what_leads_to_it(spark, small):
    for mix in (mixing.mix_documents(small[0]), mixing.mixing_digest(small[0].select("doc_id", "text", "source"))):
        plan = mix._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 10, plan.count("Exchange")
