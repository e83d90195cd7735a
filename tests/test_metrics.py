"""Metrics on hand-made vectors, edges, and against Spark's evaluators."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from riskweave.operators import leaderboard, metrics


@pytest.fixture(scope="module")
def small(spark):
    rows = zip([1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.6, 0.2], [1, 1, 1, 1, 1, 0])
    return spark.createDataFrame(list(rows), "label int, score double, prediction int")


@pytest.fixture(scope="module")
def larger(spark):
    rows = spark.range(4000).select(
        (F.hash("id") % 3 != 0).cast("int").alias("label"), (F.pmod(F.hash("id", F.lit(2)), 997) / 997).alias("score")
    )
    return rows.withColumn("prediction", (F.col("score") > 0.4).cast("int")).cache()


def test_hand_computed_areas(small):
    row = metrics.curve_areas(small).first()
    assert row["roc_auc"] == pytest.approx(13 / 18)
    assert row["pr_auc"] == pytest.approx(0.75555555, abs=1e-6)


def test_areas_with_many_buckets_equal_one_bucket(larger):
    assert metrics.curve_areas(larger, bucket_rows=50).first() == pytest.approx(metrics.curve_areas(larger).first())


def test_auc_equals_spark_evaluator(larger):
    scored = larger.withColumn("label", F.col("label").cast("double"))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert metrics.curve_areas(larger).first()["roc_auc"] == pytest.approx(evaluator.evaluate(scored))


def test_reversed_scores_mirror_the_auc(larger):
    flipped = larger.withColumn("score", -F.col("score"))
    both = metrics.curve_areas(larger).first()["roc_auc"] + metrics.curve_areas(flipped).first()["roc_auc"]
    assert both == pytest.approx(1)


@pytest.mark.parametrize(
    "ours, theirs",
    [("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"), ("weighted_f1", "f1")],
)
def test_overall_metrics_equal_spark_evaluator(larger, ours, theirs):
    scored = larger.select(*[F.col(c).cast("double").alias(c) for c in ("label", "prediction")])
    expected = MulticlassClassificationEvaluator(metricName=theirs).evaluate(scored)
    assert metrics.overall_metrics(larger).first()[ours] == pytest.approx(expected)


def test_metrics_do_not_depend_on_partitioning(larger):
    a = metrics.overall_metrics(larger).first()
    b = metrics.overall_metrics(larger.repartition(13, "score")).first()
    assert a == pytest.approx(b)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.3, 1), (1, 0.6, 1)], "label int, score double, prediction int")
    areas = metrics.curve_areas(df).first()
    assert areas["roc_auc"] is None and areas["pr_auc"] == 1.0
    row = metrics.class_metrics(df).first()
    assert (row["precision_0"], row["recall_0"], row["f1_0"], row["f1_1"]) == (0, 0, 0, 1)


def test_curve_ends(small):
    roc = {(r["fpr"], r["tpr"]) for r in metrics.roc_curve(small).collect()}
    assert {(0.0, 0.0), (1.0, 1.0)} <= roc and len(roc) == 6
    pr = metrics.precision_recall_curve(small).collect()
    assert any((r["precision"], r["recall"]) == (1.0, 0.0) and r["threshold"] is None for r in pr)
    assert {r["baseline"] for r in pr} == {0.5}


def test_curves_per_group_equal_single_curves(larger):
    grouped = larger.withColumn("g", (F.col("score") * 1000 % 2).cast("int"))
    both = {r["g"]: r["roc_auc"] for r in metrics.curve_areas(grouped, ["g"], bucket_rows=60).collect()}
    for g, auc in both.items():
        assert auc == pytest.approx(metrics.curve_areas(grouped.where(F.col("g") == g)).first()["roc_auc"])


def test_confusion_matrix_has_zero_cells(spark):
    df = spark.createDataFrame([(1, 1)], "label int, prediction int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}


def test_constant_leaderboard_metric_ranks_last(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 0.1, 0.0, 0.0), ("b", 0.5, 0.9, 0.0, 0.0)],
        "model string, p double, s double, cv_roc_auc_std double, cv_recall_0_std double",
    )
    assert [r["credit_score"] for r in leaderboard.rank_models(df, "p", "s").collect()] == [None, None]
    ranked = leaderboard.rank_models(df, "s", "s").collect()
    assert [(r["model"], r["position"]) for r in ranked] == [("b", 1), ("a", 2)]


def test_leaderboard_score_is_never_negative(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0, 9.0, 9.0), ("b", 1.0, 1.0, 0.0, 0.0)],
        "model string, p double, s double, cv_roc_auc_std double, cv_recall_0_std double",
    )
    assert {r["model"]: r["credit_score"] for r in leaderboard.rank_models(df, "p", "s").collect()} == {
        "a": 0.0, "b": pytest.approx(0.9),
    }


def test_detailed_metrics_count_rows_without_score(spark):
    rows = [("g", 1, 1, 0.9), ("g", 0, 0, 0.1), ("g", 1, 0, None), ("h", 1, 1, None)]
    df = spark.createDataFrame(rows, "part string, label int, prediction int, score double")
    found = {r["part"]: r for r in metrics.detailed_metrics(df, ["part"]).collect()}
    assert found["g"]["accuracy"] == pytest.approx(2 / 3) and found["g"]["roc_auc"] == 1.0
    assert found["h"]["accuracy"] == 1.0 and found["h"]["roc_auc"] is None


def test_detailed_metrics_compute_the_rows_once(spark):
    df = spark.range(1000).select(
        F.col("id").cast("double").alias("score"),
        *[(F.col("id") % n == 0).cast("int").alias(c) for c, n in (("label", 2), ("prediction", 3), ("part", 5))],
    )
    found = metrics.detailed_metrics(df, ["part"])
    found.collect()
    assert "Range" not in found._jdf.queryExecution().executedPlan().toString()
