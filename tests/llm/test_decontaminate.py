"""Benchmark windows against brute force and SQL."""

import re

import pytest
from check_oracle import difference, oracle_connection
from pyspark.sql import functions as F

from riskweave.llm.decontaminate import benchmark_hits, without_contaminated, without_spans
from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, width=10):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        theirs = words_of(body)
        size = min(width, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if theirs else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found)


def test_query_equals_sql(spark, sf_dir):
    con = oracle_connection(sf_dir)
    ours = LLM_QUERIES["op4_decontamination"](spark, sf_dir).toPandas()
    assert difference(ours, con.execute(LLM_ORACLES["op4_decontamination"]).df()) is None
    assert ours["contaminated"].any() and not ours["contaminated"].all()


@pytest.mark.parametrize("limit", [30, 1 << 20])
def test_edge_rows(spark, limit):
    items = [(1, "one two THREE four five six seven eight nine ten eleven"), (2, "short item"), (2, "short item"), (3, ""),
             (4, None), (None, "no id here"), (5, "Été-über 42"), (6, "...")]
    texts = ["x One two, three four five six seven eight nine TEN and short  item", "short", None, "", "été ÜBER 42", "été über 42 no id here",
             "two three four five six seven eight nine ten eleven " * 3000, "short\x00item short-item"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, texts[0], "m"), (0, texts[0], "n")], "doc_id long, text string, n_hit string")
    docs = docs.withColumn("item_id", F.lit(7))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    out = benchmark_hits(spark, docs, bench, limit=limit).collect()
    usable = [(i, t) for i, t in items if i is not None and t]
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r.n_words, r.n_hit, r.item_ids) == brute(r.text, usable)
        assert sum(s.last - s.first for s in r.hit_spans) == r.n_hit
    hits = benchmark_hits(spark, docs, bench, limit=limit)
    cut = {r.doc_id: r.text for r in without_spans(hits).filter("doc_id is not null").collect()}
    assert cut[0] == "x  and " and cut[1] == "short" and cut[2] is None and cut[7] == ""
    assert {r.doc_id for r in without_contaminated(hits).collect()} == {1, 2, 3, 4, 5}
    assert benchmark_hits(spark, docs.filter("false"), bench).count() == 0
    assert benchmark_hits(spark, docs, bench.filter("false")).filter("n_hit > 0").count() == 0
