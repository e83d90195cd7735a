"""Exact selection, cumulative sums and medians against brute force."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import order_statistics as orders
from riskweave.operators import splits


def test_cuts_hold_exactly_the_wanted_ranks(spark):
    rows = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 == 0, 0).otherwise(1))
    keyed = rows.withColumn("k", orders.hash_key(F.col("id"), 7))
    wanted = [0, 1, 17, 250, 499, 500]
    cuts = orders.key_cuts(keyed, "g", "k", lambda n: wanted)
    for group in (0, 1):
        for rank, cut in zip(wanted, cuts[group]):
            found = keyed.where((F.col("g") == group) & orders.at_or_below(F.col("k"), cut)).count()
            assert found == rank


def test_cuts_keep_a_null_group(spark):
    rows = spark.range(100).withColumn("g", F.when(F.col("id") < 30, 1))
    marked = splits.mark_test_rows(rows, label="g", key="id")
    counts = {r["g"]: r["n"] for r in marked.where("is_test").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 6, None: 14}


def test_copies_of_a_key_stay_on_one_side(spark):
    rows = spark.range(40).withColumn("same", F.lit(5)).withColumn("g", F.lit(1))
    marked = splits.mark_test_rows(rows, label="g", key="same")
    assert marked.where("is_test").count() in (0, 40)
    assert marked.count() == 40


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("within", [[], ["g"]])
def test_bucketed_running_totals_equal_one_window(spark, within, descending):
    random.seed(3)
    rows = [(random.choice([0, 1, 1, 1]), v, random.randint(0, 9)) for v in random.sample(range(10**6), 3000)]
    df = spark.createDataFrame([(g, v / 7, n) for g, v, n in rows], "g int, v double, n long")
    bucketed = orders.running_totals(df, within, "v", {"n": "upto"}, descending, bucket_rows=100)
    order = F.col("v").desc() if descending else F.col("v")
    plain = df.withColumn("upto", F.sum("n").over(Window.partitionBy(*within).orderBy(order)))
    assert sorted(map(tuple, bucketed.select("g", "v", "upto").collect())) == sorted(
        map(tuple, plain.select("g", "v", "upto").collect())
    )


def test_bucketed_running_totals_survive_a_hot_value(spark):
    values = [0.5] + [0.5 + i / 10**6 for i in range(1, 2000)]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n long")
    out = orders.running_totals(df, [], "v", {"n": "upto"}, bucket_rows=64)
    assert sorted(r["upto"] for r in out.collect()) == list(range(1, 2001))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    present = [v for v in values if v is not None]
    expected = statistics.median(present) if present else None
    assert orders.medians_and_means(df, ["v"], bucket_rows=5)["v"] == expected


def test_medians_of_all_null_constant_and_nan_columns(spark):
    df = spark.createDataFrame(
        [(None, 2.0, 1.0), (None, 2.0, float("nan")), (None, 2.0, 4.0)], "a double, b double, c double"
    )
    found = orders.medians_and_means(df, ["a", "b", "c"], ["b"])
    assert found == {"a": None, "b": 2.0, "c": 2.5}


def test_folds_partition_the_rows_evenly(spark):
    rows = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    folded = splits.stratified_folds(rows, 5, "y", "id")
    assert folded.count() == 1003
    per_class = {}
    for r in folded.groupBy("y", "fold").count().collect():
        per_class.setdefault(r["y"], []).append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in per_class.values())


def test_folds_do_not_depend_on_row_order(spark):
    rows = spark.range(500).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    one = {r["id"]: r["fold"] for r in splits.stratified_folds(rows, 4, "y", "id").collect()}
    other = {r["id"]: r["fold"] for r in splits.stratified_folds(rows.repartition(7), 4, "y", "id").collect()}
    assert one == other


def test_shuffle_splits_differ_between_repeats(spark):
    copies = splits.shuffle_splits(spark.range(100), repeats=3, key="id")
    tests = [{r["id"] for r in copies.where(f"repeat = {i} and is_test").collect()} for i in (1, 2, 3)]
    assert [len(t) for t in tests] == [20, 20, 20]
    assert tests[0] != tests[1] != tests[2]


def test_empty_tables(spark):
    empty = spark.range(0).withColumn("y", F.lit(1))
    assert splits.mark_test_rows(empty, "y", "id").count() == 0
    assert splits.stratified_folds(empty, 5, "y", "id").count() == 0
    assert orders.medians_and_means(empty.select(F.col("id").cast("double").alias("v")), ["v"]) == {"v": None}


def test_keys_are_made_twice_however_deep_the_search(spark, monkeypatch):
    """What shares a prefix with a cut is written after the first pass, and later passes read that alone."""
    from riskweave.operators import order_statistics

    written = []
    monkeypatch.setattr(order_statistics, "MAX_COUNTERS", 16)
    monkeypatch.setattr(order_statistics, "materialised", lambda df, name: written.append(df.count()) or df.localCheckpoint())
    keyed = spark.range(3_000).select(F.lit(1).alias("g"), order_statistics.hash_key(F.col("id"), 5).alias("_key"))
    cuts = order_statistics.key_cuts(keyed, "g", "_key", lambda n: [700, 2_100], 1)
    assert [keyed.where(F.col("_key") <= cut).count() for cut in cuts[1]] == [700, 2_100]
    assert len(written) == 1 and written[0] < 600
