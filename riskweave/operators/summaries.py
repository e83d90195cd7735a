"""Class balance, scoring summaries and prediction-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import risk
from riskweave.functions.scalars import as_day, money, pct, short_time, three_decimals


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class shares and the weight that balances positives against negatives."""
    positive = F.count(F.when(F.col(label) == 1, 1))
    negative = F.count(F.when(F.col(label) == 0, 1))
    return df.agg(
        positive.alias("positives"),
        negative.alias("negatives"),
        F.try_divide(positive.cast("double"), F.count(label).cast("double")).alias("share_1"),
        F.try_divide(negative.cast("double"), F.count(label).cast("double")).alias("share_0"),
        (negative / F.greatest(positive, F.lit(1))).alias("positive_weight"),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * count of the class), one row per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(classes) / (F.count(F.lit(1)).over(classes) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_balanced_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Append the balanced class weight; labels are few, so the weights become literals."""
    chain = F
    for row in balanced_weights(df, label).collect():
        chain = chain.when(F.col(label) == row[label], F.lit(row["weight"]))
    return df.withColumn(output, F.lit(None).cast("double") if chain is F else chain)


def _share(test: Column) -> Column:
    return pct(F.count(F.when(test, 1)), F.count(F.lit(1)))


def scoring_summary(scored: DataFrame) -> DataFrame:
    """Nine totals of a scored batch; percentages are null for an empty one."""
    pays = F.col("prediction") == 1
    approved = risk.is_approved(F.col("recommendation"))
    return scored.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(F.when(pays, 1)).alias("payers"),
        F.count(F.when(~pays, 1)).alias("non_payers"),
        _share(pays).alias("payer_pct"),
        F.count(F.when(risk.is_high_risk(F.col("risk_level")), 1)).alias("high_risk"),
        F.count(F.when(approved, 1)).alias("approved"),
        _share(approved).alias("approval_pct"),
        F.round(F.avg("probability"), 4).alias("mean_probability"),
        F.round(F.avg("risk_score"), 2).alias("mean_risk_score"),
    )


def file_scoring_summary(scored: DataFrame) -> DataFrame:
    """The shorter summary of a scored file."""
    return scoring_summary(scored).select(
        F.col("total_predictions").alias("total_records"),
        "payers",
        "non_payers",
        "payer_pct",
        "approved",
        "approval_pct",
        "mean_risk_score",
    )


def first_rows(scored: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """The rows a response carries: the first by key."""
    return scored.orderBy(key).limit(limit)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per non-null value, largest first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Key figures of a log window and its risk distribution as a map.

    An empty window keeps its row, with status ``no_data`` and null figures. The
    log is first rolled up per risk level (a handful of rows), then once more.
    """
    per_level = log.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("prediction") == 1, 1)).alias("approved"),
        F.sum("probability").alias("p_sum"),
        F.count("probability").alias("p_n"),
        F.max("timestamp").alias("latest"),
        F.sum("capital_prestado").alias("loan_sum"),
        F.count("capital_prestado").alias("loan_n"),
        F.sum("puntaje_datacredito").alias("score_sum"),
        F.count("puntaje_datacredito").alias("score_n"),
    )

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n").cast("double"))

    total = F.coalesce(F.sum("n"), F.lit(0))
    entries = F.collect_list(F.when(F.col("risk_level").isNotNull(), F.struct("risk_level", "n")))
    return per_level.agg(
        F.when(total > 0, "ok").otherwise("no_data").alias("status"),
        total.alias("total_predictions"),
        (F.try_divide(F.sum("approved").cast("double"), F.sum("n").cast("double")) * 100).alias("approval_rate"),
        mean("p").alias("avg_probability"),
        F.max("latest").alias("latest_prediction"),
        mean("loan").alias("avg_loan_amount"),
        mean("score").alias("avg_credit_score"),
        F.map_from_entries(F.array_sort(entries)).alias("risk_distribution"),
    )


def daily_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(as_day(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def amount_histogram(log: DataFrame, column: str = "capital_prestado", bins: int = 15) -> DataFrame:
    """Equal-width histogram between the smallest and the largest value."""
    low, high = log.agg(F.min(column), F.max(column)).first()
    present = log.where(F.col(column).isNotNull())
    if low is None or low == high:
        bucket, low, width = F.lit(1), F.lit(low).cast("double"), F.lit(0.0)
    else:
        bucket = F.least(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
        low, width = F.lit(low), F.lit((high - low) / bins)
    return (
        present.groupBy(bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", (low + width * (F.col("bucket") - 1)).alias("low_edge"), "n")
    )


def probability_over_time(log: DataFrame) -> DataFrame:
    return log.select("id", "timestamp", "probability").orderBy("timestamp", "id")


def recent_view(log: DataFrame, limit: int = 10) -> DataFrame:
    """The newest rows, formatted for display under their display names."""
    newest = log.orderBy(F.desc("timestamp"), "id").limit(limit)
    return newest.select(
        short_time(F.col("timestamp")).alias("Fecha/Hora"),
        money(F.col("capital_prestado")).alias("Monto"),
        F.col("plazo_meses").alias("Plazo"),
        F.col("edad_cliente").alias("Edad"),
        risk.decision_name(F.col("prediction")).alias("Predicción"),
        three_decimals(F.col("probability")).alias("Probabilidad"),
        F.col("risk_level").alias("Riesgo"),
    )


def recent_lines(log: DataFrame, limit: int = 5) -> DataFrame:
    """The newest rows as one text line each."""
    newest = log.orderBy(F.desc("timestamp"), "id").limit(limit)
    return newest.select(
        "id",
        F.concat_ws(
            " | ",
            short_time(F.col("timestamp")),
            money(F.col("capital_prestado")),
            F.concat(F.lit("Pred: "), F.col("prediction").cast("string")),
            F.concat(F.lit("Prob: "), three_decimals(F.col("probability"))),
            F.concat(F.lit("Risk: "), F.col("risk_level")),
        ).alias("line"),
    )
