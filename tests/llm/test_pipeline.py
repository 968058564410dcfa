"""The pipeline's stages on the smallest tables and on odd rows."""

import corpus_pipeline
from wordloom.llm import queries
from wordloom.llm.queries import QUERIES


def test_stages_on_small_tables(spark, small):
    docs = spark.read.parquet(f"{small[2]}/documents.parquet")
    ids = {d for d, _ in small[1]}
    out = corpus_pipeline.run(spark, small[2]).collect()
    assert out and {r["doc_id"] for r in out} <= ids
    texts = dict(small[1])
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    sharded = spark.createDataFrame(out)
    assert sharded.columns == [*docs.columns, "shard", "slot"]
    counts = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_stages_on_odd_rows(spark, small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, small[2])
            rows = result.collect()
            assert name == "sharding" or result.columns == docs.columns
            if name != "mixing":
                assert len(rows) <= docs.count()
            if docs is no_docs:
                assert not rows


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(QUERIES)


def test_queries_equal_sql(spark, small, duck):
    for name, sql in queries.ORACLE.items():
        result = duck.execute(sql)
        columns = [column[0] for column in result.description]
        ours = QUERIES[name](spark, small[2])
        assert sorted(ours.columns) == sorted(columns)
        assert sorted(map(tuple, ours.select(columns).collect()), key=str) == sorted(result.fetchall(), key=str), name
