"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm.graph import components
from riskweave.llm.queries import LLM_QUERIES
from riskweave.llm.simhash import near_duplicates_removed, near_links, simhash_components


def brute_fingerprint(text, width=4):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if bin(prints[ids[x]] ^ prints[ids[y]]).count("1") <= distance:
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    expected = brute_components(prints)
    rows = LLM_QUERIES["op9_simhash_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, " \n", "z"), (4, "Hello World", "a"), (5, "hello\tworld", "b"),
            (5, "hello\tworld", "b"), (6, "é" * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("Fingerprint", F.lit(1))
    out = simhash_components(spark, docs).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (None, 1), (4, 4), (5, 4), (6, 6)}
    kept = near_duplicates_removed(spark, docs.drop("Fingerprint")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 6]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    repeated = spark.createDataFrame([(5, "same words here"), (5, "same words here")], "doc_id long, text string")
    assert near_duplicates_removed(spark, repeated).count() == 1
    empty = docs.filter("false")
    assert simhash_components(spark, empty).count() == 0 and near_duplicates_removed(spark, empty).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("crowd", [3, 2000])
def test_links_in_crowds(spark, distance, crowd):
    if distance == 5 and crowd == 3:
        pytest.skip("41,728 midpoints a fingerprint")
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(values)[:4]:
        for _ in range(20):
            value = centre
            for _ in range(rng.randrange(1, 7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    links = near_links(spark, nodes, distance, crowd)
    for u, v in links.collect():
        assert bin((u ^ v) & (1 << 64) - 1).count("1") <= distance
    found = {r.node: r.label for r in components(spark, links).collect()}
    expected = brute_components({signed[v]: v for v in values}, distance)
    sizes = {}
    for v in expected.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert found == {v: c for v, c in expected.items() if sizes[c] > 1}


@pytest.mark.parametrize("crowd", [2000, 1])
def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path, crowd):
    rows = spark.range(40).select((F.col("id") * 7919).alias("fp"), F.col("id").alias("least"))
    rows.write.parquet(str(tmp_path / "nodes"))
    links = near_links(spark, spark.read.parquet(str(tmp_path / "nodes")), 2, crowd=crowd)
    joins = [line for line in links._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and " Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins
