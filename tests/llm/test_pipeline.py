"""Stages against what they must keep and drop."""

from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm.queries import LLM_QUERIES
from riskweave.llm.scratch import saved

from .test_decontaminate import brute as brute_hits
from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_components, brute_fingerprint


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(stages) == 5 and not set(names) & set(LLM_QUERIES)
    kept = saved(spark, stages[0](spark, docs, sf_dir), "stage")
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty() and kept.count() > 0.9 * docs.filter("text rlike '[A-Za-z]'").count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    later, _ = brute_lines(rows, 80)
    expected = {}
    for i, text in rows:
        gone = later.get((i, text), set())
        left = [line for n, line in enumerate(text.split("\n")) if n not in gone]
        if any(line.encode().split() for line in left):
            expected[i] = "\n".join(left)
    lines = saved(spark, stages[1](spark, kept, sf_dir), "stage")
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == expected
    assert lines.filter("n_chars != length(text)").isEmpty()

    groups = brute_components({i: brute_fingerprint(t) for i, t in expected.items()})
    single = saved(spark, stages[2](spark, lines, sf_dir), "stage")
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i, c in groups.items() if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = saved(spark, stages[3](spark, single, sf_dir), "stage")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not brute_hits(r.text, items)[1]}

    tokens = stages[4](spark, clean, sf_dir).collect()
    whole = {r.doc_id: r for r in LLM_QUERIES["op10_bpe"](spark, sf_dir).collect()}
    unchanged = {r.doc_id for r in clean.join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_semi").collect()}
    assert {r.doc_id for r in tokens} == {r.doc_id for r in clean.collect()}
    assert all(whole[r.doc_id] == r for r in tokens if r.doc_id in unchanged)
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tokens)


def test_clashing_columns_and_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("s")).withColumn("n_hit", F.lit(1.5)).withColumn("fingerprint", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), "stage")
        assert docs.columns[-3:] == ["score", "n_hit", "fingerprint"]
        assert docs.filter("score = 's' and n_hit = 1.5 and fingerprint = 2").count() == docs.count() > 0
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
