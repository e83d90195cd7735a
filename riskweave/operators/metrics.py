"""Binary-classification metrics as grouped aggregation.

Every function takes ``within``: columns that split the rows into independent
evaluations (model, fold, part). All of them are computed in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.risk import CLASS_NAMES, class_name
from riskweave.operators.encoding import feature_names
from riskweave.operators.order_statistics import BUCKET_ROWS, running_totals
from riskweave.session import materialised

LABEL = "label"
PREDICTION = "prediction"
SCORE = "score"


def ratio(part: Column, whole: Column) -> Column:
    """Division that is 0 where undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _tally(test: Column, copies: str | None) -> Column:
    """Rows that pass, or the copies they stand for when rows are already counted."""
    if copies is None:
        return F.count(F.when(test, 1))
    return F.sum(F.when(test, F.col(copies)).otherwise(0))


def confusion_counts(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, prediction=PREDICTION, copies: str | None = None
) -> DataFrame:
    """Wide confusion counts n00, n01, n10, n11 (actual, predicted) per group."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*within).agg(
        *[_tally((y == a) & (p == b), copies).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    )


def confusion_matrix(df: DataFrame, within: Sequence[str] = (), label=LABEL, prediction=PREDICTION) -> DataFrame:
    """Long 2x2 matrix with its zero cells."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"n{a}{b}").alias("n"))
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    return confusion_counts(df, within, label, prediction).select(*within, F.inline(cells))


def _with_rates(counts: DataFrame) -> DataFrame:
    """Per-class and overall rates from wide confusion counts."""
    n = {k: F.col(f"n{k}") for k in ("00", "01", "10", "11")}
    out = counts.withColumns(
        {
            "n": n["00"] + n["01"] + n["10"] + n["11"],
            "support_0": n["00"] + n["01"],
            "support_1": n["10"] + n["11"],
            "precision_0": ratio(n["00"], n["00"] + n["10"]),
            "recall_0": ratio(n["00"], n["00"] + n["01"]),
            "precision_1": ratio(n["11"], n["11"] + n["01"]),
            "recall_1": ratio(n["11"], n["11"] + n["10"]),
        }
    )
    return out.withColumns(
        {
            "accuracy": F.try_divide((n["00"] + n["11"]).cast("double"), F.col("n").cast("double")),
            "f1_0": f1(F.col("precision_0"), F.col("recall_0")),
            "f1_1": f1(F.col("precision_1"), F.col("recall_1")),
        }
    )


def _weighted(name: str) -> Column:
    total = F.col(f"{name}_0") * F.col("support_0") + F.col(f"{name}_1") * F.col("support_1")
    return F.try_divide(total, F.col("n").cast("double"))


def overall_metrics(df: DataFrame, within: Sequence[str] = (), label=LABEL, prediction=PREDICTION) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    return _with_rates(confusion_counts(df, within, label, prediction)).select(
        *within,
        F.col("n").alias("cases"),
        "accuracy",
        *[_weighted(name).alias(f"weighted_{name}") for name in ("precision", "recall", "f1")],
    )


def class_metrics(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, prediction=PREDICTION, copies: str | None = None
) -> DataFrame:
    """Accuracy and precision, recall, F1 of both classes, one row per group."""
    return _with_rates(confusion_counts(df, within, label, prediction, copies)).select(
        *within,
        "accuracy",
        *[f"{name}_{c}" for c in (0, 1) for name in ("precision", "recall", "f1")],
    )


def classification_report(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, prediction=PREDICTION, digits: int = 3
) -> DataFrame:
    """Rows per class, accuracy, macro and weighted average."""
    names = ("precision", "recall", "f1")

    def row(title: str, values: list[Column], support: Column) -> Column:
        return F.struct(
            F.lit(title).alias("row"),
            *[F.round(v, digits).alias(k) for k, v in zip(names, values)],
            support.alias("support"),
        )

    rows = [
        row(f"{CLASS_NAMES[c]} ({c})", [F.col(f"{k}_{c}") for k in names], F.col(f"support_{c}"))
        for c in (0, 1)
    ]
    rows.append(row("accuracy", [F.col("accuracy")] * 3, F.col("n")))
    rows.append(row("macro avg", [(F.col(f"{k}_0") + F.col(f"{k}_1")) / 2 for k in names], F.col("n")))
    rows.append(row("weighted avg", [_weighted(k) for k in names], F.col("n")))
    rated = _with_rates(confusion_counts(df, within, label, prediction))
    return rated.select(*within, F.inline(F.array(*rows)))


def threshold_counts(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, score=SCORE, copies: str | None = None
) -> DataFrame:
    """Positives and negatives per distinct score: all that the curves need.

    Rows that are already counted keep their missing scores as one empty group:
    a filter would be pushed below that count and keep it from being shared.
    """
    present = F.col(score).isNotNull()
    rows = df if copies else df.where(present & F.col(label).isNotNull())
    return rows.groupBy(*within, F.col(score).cast("double").alias("threshold")).agg(
        _tally(present & (F.col(label) == 1), copies).alias("pos"),
        _tally(present & (F.col(label) != 1), copies).alias("neg"),
    )


def cumulative_counts(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, score=SCORE, bucket_rows: int = BUCKET_ROWS,
    copies: str | None = None,
) -> DataFrame:
    """True and false positives at every distinct threshold, from the highest down."""
    return _accumulated(threshold_counts(df, within, label, score, copies), within, bucket_rows)


def _accumulated(counts: DataFrame, within: Sequence[str], bucket_rows: int) -> DataFrame:
    return running_totals(
        counts, within, "threshold", {"pos": "tp", "neg": "fp"}, descending=True, bucket_rows=bucket_rows
    )


def curve_areas(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, score=SCORE, bucket_rows: int = BUCKET_ROWS,
    copies: str | None = None,
) -> DataFrame:
    """Exact ROC AUC (trapezoids) and average precision per group.

    ROC AUC is null when a group has one class only; average precision is 0
    when it has no positives.
    """
    curve = cumulative_counts(df, within, label, score, bucket_rows, copies)
    positives, negatives = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp")))
    return curve.groupBy(*within).agg(
        F.try_divide(area, positives.cast("double") * negatives).alias("roc_auc"),
        ratio(steps, positives).alias("pr_auc"),
    )


def _join_groups(left: DataFrame, right: DataFrame, within: Sequence[str]) -> DataFrame:
    """Per-group rows onto ``left``; null-safe, so a null group stays and no branch gets a filter of its own."""
    renamed = right.withColumnsRenamed({w: f"_{w}" for w in within})
    same = reduce(lambda a, b: a & b, [F.col(w).eqNullSafe(F.col(f"_{w}")) for w in within])
    return left.join(renamed, same, "left").drop(*[f"_{w}" for w in within])


def _totals(counts: DataFrame, within: Sequence[str]) -> DataFrame:
    """Each group's class totals; one tiny row per evaluation."""
    totals = counts.groupBy(*within).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if within:
        return totals
    return counts.sparkSession.createDataFrame(totals.collect(), totals.schema)


def _curve(df, within, label, score, bucket_rows, start: dict[str, Column], point: dict[str, Column]) -> DataFrame:
    """Points at every threshold, and the fixed point at the end where nothing is predicted positive.

    The counts per threshold are computed once, for the totals as for the curve.
    """
    counts = materialised(threshold_counts(df, within, label, score), "thresholds")
    totals = _totals(counts, within)
    counts = _accumulated(counts, within, bucket_rows)
    if within:
        counts = _join_groups(counts, totals, within)
    else:
        row = totals.first()
        counts = counts.withColumns({k: F.lit(row[k]).cast("long") for k in ("all_pos", "all_neg")})
    points = counts.select(*within, "threshold", *[c.alias(k) for k, c in point.items()])
    ends = totals.where(F.col("all_pos") + F.col("all_neg") > 0).select(
        *within, F.lit(None).cast("double").alias("threshold"), *[c.alias(k) for k, c in start.items()]
    )
    return points.unionByName(ends)


def roc_curve(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, score=SCORE, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """fpr and tpr at every distinct threshold plus the (0, 0) start (null threshold)."""
    return _curve(
        df, within, label, score, bucket_rows,
        {"fpr": F.lit(0.0), "tpr": F.lit(0.0)},
        {
            "fpr": F.try_divide(F.col("fp").cast("double"), F.col("all_neg").cast("double")),
            "tpr": F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")),
        },
    )


def precision_recall_curve(
    df: DataFrame, within: Sequence[str] = (), label=LABEL, score=SCORE, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Precision and recall per threshold, the (1, 0) end point, and the baseline mean(y)."""
    baseline = F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double"))
    return _curve(
        df, within, label, score, bucket_rows,
        {"precision": F.lit(1.0), "recall": F.lit(0.0), "baseline": baseline},
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": F.coalesce(recall, F.lit(1.0)),
            "baseline": baseline,
        },
    )


def detailed_metrics(
    df: DataFrame, within: Sequence[str], label=LABEL, prediction=PREDICTION, score=SCORE
) -> DataFrame:
    """Class metrics joined with the curve areas: one row per group.

    Rows are first counted per (group, label, prediction, score); both kinds of
    metric are rolled up from those counts, which are computed once.
    """
    cells = df.groupBy(*within, label, prediction, score).agg(F.count(F.lit(1)).alias("copies"))
    cells = materialised(cells, "cells")
    areas = curve_areas(cells, within, label, score, copies="copies")
    return _join_groups(class_metrics(cells, within, label, prediction, "copies"), areas, within)


def segment_performance(df: DataFrame, segment: str = "tipo_laboral", label=LABEL, prediction=PREDICTION) -> DataFrame:
    """Cases, accuracy and weighted precision and recall per segment."""
    return overall_metrics(df, [segment], label, prediction).select(
        F.col(segment).alias("segment"),
        "cases",
        "accuracy",
        F.col("weighted_precision").alias("precision"),
        F.col("weighted_recall").alias("recall"),
    )


def executive_summary(df: DataFrame, label=LABEL, prediction=PREDICTION) -> DataFrame:
    """Totals of the evaluation: cases, correct, accuracy %, TP, FP, FN."""
    rated = _with_rates(confusion_counts(df, (), label, prediction))
    return rated.select(
        F.col("n").alias("total_cases"),
        (F.col("n00") + F.col("n11")).alias("correct_predictions"),
        (F.col("accuracy") * 100).alias("accuracy_pct"),
        F.col("n11").alias("true_positives"),
        F.col("n01").alias("false_positives"),
        F.col("n10").alias("false_negatives"),
    )


def with_errors(df: DataFrame, label=LABEL, prediction=PREDICTION) -> DataFrame:
    return df.withColumn("is_error", ~F.col(label).eqNullSafe(F.col(prediction)))


def error_rate(df: DataFrame, label=LABEL, prediction=PREDICTION) -> DataFrame:
    return with_errors(df, label, prediction).agg(
        F.avg(F.col("is_error").cast("double")).alias("error_rate")
    )


def error_cases(df: DataFrame, key: str, limit: int = 10, label=LABEL, prediction=PREDICTION) -> DataFrame:
    """The first misclassified rows by key."""
    return with_errors(df, label, prediction).where("is_error").orderBy(key).limit(limit)


def predictions_by_class(df: DataFrame, label=LABEL, prediction=PREDICTION) -> DataFrame:
    """Row counts of each prediction per true class."""
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def probability_histogram(df: DataFrame, label=LABEL, score=SCORE, bins: int = 20) -> DataFrame:
    """Equal-width probability bins over [0, 1], counted per true class."""
    bucket = F.least(F.floor(F.col(score) * bins) + 1, F.lit(bins)).cast("int")
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(class_name(F.col(label)).alias("actual_class"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_importances(model: Model, transformed: DataFrame, limit: int = 15) -> DataFrame:
    """Largest feature importances with the names of their columns."""
    importances = model.featureImportances.toArray().tolist()
    rows = list(zip(feature_names(transformed), importances))
    return (
        transformed.sparkSession.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(limit)
    )
