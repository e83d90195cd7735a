"""Candidates against a regular expression; findings on held-out texts; edge rows."""

import re

from pyspark.sql import functions as F

from riskweave.llm import secrets
from riskweave.llm.queries import LLM_QUERIES


def test_candidates_equal_the_pattern(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    expected = {}
    for r in docs.collect():
        for n, m in enumerate(re.finditer(secrets.CANDIDATE, r.text or ""), 1):
            expected[r.doc_id, n] = m.group()
    assert {(r.id, r.place): r.value for r in secrets.candidates(docs).collect()} == expected


def test_held_out_findings(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = LLM_QUERIES["op3_secret_scan"](spark, sf_dir).toPandas()
    held = out[out["doc_id"].map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2)]
    assert held["format_label"].sum() >= 3
    assert (held["is_secret"] == (held["format_label"] == 1)).mean() > 0.95


def test_edge_rows(spark):
    key = "AKIA" + "Q7" * 8
    text = f"x {key} y token = \"{'0123456789abcdef' * 2}\" /usr/lib/python/site-packages/x {key}\u0001{key}"
    rows = [(1, text, "v"), (2, None, "v"), (3, "", "v"), (None, text, "v"), (4, "a" * 200_000, "v"), (4, "a" * 200_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string").withColumn("score", F.lit(1))
    found = secrets.candidates(docs).collect()
    mine = [r for r in sorted(found, key=lambda r: r.place) if r.id == 1]
    assert [r.value for r in mine] == re.findall(secrets.CANDIDATE, text)
    assert mine[1].before.endswith('token = "') and mine[1].after.startswith('"') and mine[0].before == "x "
    out = secrets.scan(spark, docs).collect()
    assert len(out) == len(found) == 2 * len(mine) + 2 and all(r.score is not None for r in out)
    one_kind = secrets.scan(spark, docs.filter("doc_id = 4")).collect()
    assert all(r.is_secret and r.score is None for r in one_kind) and len(one_kind) == 2
    labelled = spark.createDataFrame([(key, "x ", " y", 1), ("a" * 40, "b ", " c", 0), ("b" * 30, "b ", " c", None)] * 10,
                                     "value string, before string, after string, label int")
    given = {r.value: r.is_secret for r in secrets.scan(spark, docs, labelled).collect()}
    assert given[key] and not given["a" * 200_000]
    assert secrets.scan(spark, docs.filter("false")).count() == 0


def test_planted_keys_of_other_formats(spark):
    planted = [
        "9233A8EC" * 5, "0123456789aBcDeF" * 2, "c2VjcmV0IHZhbHVlIG51bWJlciA3/w==", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY", "gh" + "p_" + "a1B2c3" * 6,
        "eyJhbGciOiJIUzI1NiJ9", "sk" + "_live_" + "4eC39HqLyjWDarjtT1zdp7dc", "AS" + "IA" + "Q7" * 8,
    ]
    rows = [(k, "TOKEN = \"", "\"") for k in planted] + [
        ("some_other_variable", "key = ", ""), ("x" * 43, ".", " "), ("9233A8EC" * 5, "commit ", ""), ("site-packages/module", "lib/", "")]
    found = secrets.labelled_by_format(spark.createDataFrame(rows, "value string, before string, after string"))
    labels = [r.label for r in found.collect()]
    assert labels == [1] * len(planted) + [None, None, 0, 0]
    docs = spark.createDataFrame(
        [(i, f'TOKEN = "{i * 7919:08X}{i * 104729 + 11:016X}{i * 1299709:016X}" but site-packages/module{i}/lib and a plain-hyphenated-name-{i}') for i in range(200)],
        "doc_id long, text string")
    out = secrets.scan(spark, docs).collect()
    assert all(r.is_secret == (r.place == 1) for r in out)
