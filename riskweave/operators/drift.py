"""Feature drift between the newest predictions and the ones before them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import pct_change
from riskweave.functions.stats import pooled_t, student_p_value
from riskweave.schema import LOGGED_FEATURES
from riskweave.sources.prediction_log import as_timestamp, moment, recent_log

# Window lengths in days, row guards, and drift thresholds.
RECENT_DAYS = 3
HISTORY_DAYS = 14
MIN_RECENT_ROWS = 5
MIN_TOTAL_ROWS = 10
MIN_OLDER_ROWS = 5
MIN_VALUES = 3
CHANGE_LIMIT_PCT = 15
P_LIMIT = 0.05


def _marked(log: DataFrame, as_of: str | datetime) -> DataFrame:
    start = as_timestamp(as_of) - timedelta(days=RECENT_DAYS)
    return recent_log(log, HISTORY_DAYS, as_of).withColumn("is_recent", F.col("timestamp") >= moment(log, "timestamp", start))


def drift_status(log: DataFrame, as_of: str | datetime) -> DataFrame:
    """Row counts of both windows and whether they suffice for a comparison."""
    recent = F.count(F.when(F.col("is_recent"), 1))
    older = F.count(F.when(~F.col("is_recent"), 1))
    counts = _marked(log, as_of).agg(recent.alias("recent_rows"), older.alias("older_rows"))
    few_new = (F.col("recent_rows") < MIN_RECENT_ROWS) | (
        F.col("recent_rows") + F.col("older_rows") < MIN_TOTAL_ROWS
    )
    few_old = F.col("older_rows") < MIN_OLDER_ROWS
    return counts.select(
        F.when(few_new | few_old, "insufficient_data").otherwise("ok").alias("status"),
        F.when(few_new, "more predictions are needed")
        .when(few_old, "more history is needed")
        .alias("message"),
        "recent_rows",
        "older_rows",
    )


def drift_by_feature(log: DataFrame, as_of: str | datetime, features: list[str] | None = None) -> DataFrame:
    """Means, change, t-test and drift flag per feature; empty when data are too few.

    One scan without exploding rows: every task sends one row of partial
    aggregates, and features become rows only after that.
    """
    features = [f for f in (features or LOGGED_FEATURES) if f in log.columns]
    new, old = F.col("is_recent"), ~F.col("is_recent")
    kinds = {"n": F.count, "mean": F.avg, "var": F.var_samp}
    sides = {"recent": new, "older": old}
    totals = _marked(log, as_of).agg(
        *[F.count(F.when(test, 1)).alias(f"{side}_rows") for side, test in sides.items()],
        *[
            kind(F.when(test, F.col(f).cast("double"))).alias(f"{side}_{name}__{f}")
            for f in features
            for side, test in sides.items()
            for name, kind in kinds.items()
        ],
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"{side}_{name}__{f}").alias(f"{side}_{name}") for side in sides for name in kinds],
        )
        for f in features
    ]
    stats = totals.select("recent_rows", "older_rows", F.inline(F.array(*rows)))
    enough = (
        (F.col("recent_rows") >= MIN_RECENT_ROWS)
        & (F.col("recent_rows") + F.col("older_rows") >= MIN_TOTAL_ROWS)
        & (F.col("older_rows") >= MIN_OLDER_ROWS)
        & (F.col("recent_n") >= MIN_VALUES)
        & (F.col("older_n") >= MIN_VALUES)
    )
    tested = stats.where(enough).select(
        "feature",
        "recent_n",
        "older_n",
        "recent_mean",
        "older_mean",
        pct_change(F.col("recent_mean"), F.col("older_mean")).alias("change_pct"),
        pooled_t(
            F.col("recent_mean"), F.col("recent_var"), F.col("recent_n"),
            F.col("older_mean"), F.col("older_var"), F.col("older_n"),
        ).alias("t_stat"),
    )
    # without pooled variance different means differ for certain, equal ones not
    p = F.when(F.col("t_stat").isNotNull(), student_p_value(F.col("t_stat"), (F.col("recent_n") + F.col("older_n") - 2).cast("double"))).when(
        F.col("recent_mean") != F.col("older_mean"), F.lit(0.0)
    )
    tested = tested.withColumn("p_value", p)
    drifted = (F.abs("change_pct") > CHANGE_LIMIT_PCT) | F.coalesce(F.col("p_value") < P_LIMIT, F.lit(False))
    return tested.withColumn("drift_detected", drifted)


def drift_totals(drift: DataFrame) -> DataFrame:
    """How many features were compared and how many drifted."""
    return drift.agg(
        F.count(F.lit(1)).alias("features_analysed"),
        F.count(F.when(F.col("drift_detected"), 1)).alias("features_drifted"),
    )
