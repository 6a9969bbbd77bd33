"""The pipeline against its stages by brute force, on the smallest tables."""

import corpus_pipeline
from sumwise.llm.queries import QUERIES
from test_decontaminate import brute as passages
from test_near_duplicates import brute as groups

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in QUERIES["op1_toxicity"](spark, FOLDER).where("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    one = corpus_pipeline.not_toxic(spark, docs, FOLDER)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(rows)
    kept = {r[0] for r in groups(list(rows.items())) if r[3]}
    two = corpus_pipeline.one_of_each_group(spark, one, FOLDER)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept
    clean = kept - {r[0] for r in passages([(i, rows[i]) for i in kept], items)}
    three = corpus_pipeline.without_benchmark(spark, two, FOLDER)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == clean
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == clean
    assert sum(r.n_tokens for r in got) == sum(len((rows[i] or "").encode()) for i in clean)
    assert len(clean) < len(kept) < len(rows)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_nulls_and_repeated_rows_pass(spark):
    rows = [(1, None, None, None, None), (None, "some words of a text here", "en", "s", 3), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, FOLDER).collect()
        assert sorted(map(tuple, left), key=str) == sorted(rows, key=str), name
