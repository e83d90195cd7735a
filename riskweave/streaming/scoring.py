"""Scoring of arriving records and daily counts of the log, as streams."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.scalars import as_day
from riskweave.operators.validation import typed_records, with_violations
from riskweave.plans.score import score_records, with_exclusions
from riskweave.schema import CORRUPT, RAW_SCHEMA
from riskweave.sources.prediction_log import LOG_TABLE_SCHEMA, append_predictions

BATCH = "batch"


def record_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON records arriving in a folder, typed."""
    reader = (
        spark.readStream.schema(RAW_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_records(reader.json(folder))


def _replace_batch(rows: DataFrame, location: str, batch: str) -> None:
    (
        rows.withColumn(BATCH, F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH)
        .parquet(location)
    )


def start_scoring(
    records: DataFrame,
    features: PipelineModel,
    model: Model,
    log_location: str,
    rejected_location: str,
    checkpoint: str,
    name: str = "scoring",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score valid records into the log; put the others aside with their reasons.

    Each micro-batch replaces its own partitions. Its time is fixed in the stream's
    offset log, so a batch that is repeated later, even on another day, leaves the
    same rows with the same ids. By default all waiting records are processed,
    then it stops.
    """
    records = records.withColumn("timestamp", F.current_timestamp())

    def handle(batch: DataFrame, number: int) -> None:
        checked = with_exclusions(with_violations(batch), features)
        reasons = F.concat("violations", "excluded_because")
        checked = checked.withColumn("reasons", reasons).drop("violations", "excluded_because").persist()
        try:
            usable = F.size("reasons") == 0
            label = f"{name}-{number}"
            scored = score_records(checked.where(usable).drop("reasons"), features, model)
            append_predictions(scored, log_location, label)
            _replace_batch(checked.where(~usable), rejected_location, label)
        finally:
            checked.unpersist()

    return (
        records.writeStream.queryName(name)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def log_stream(spark: SparkSession, location: str) -> DataFrame:
    return spark.readStream.schema(LOG_TABLE_SCHEMA).parquet(location)


def running_daily_counts(log: DataFrame) -> DataFrame:
    """Running counts per day of event time, however late its rows come; the state is one row a day."""
    return log.groupBy(as_day(F.col("timestamp").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def start_daily_counts(
    log: DataFrame, location: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep a day-partitioned count table current.

    Update mode emits the new total of every day that changed; each replaces the
    partition of its day.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        (
            batch.repartition("day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(location)
        )

    return (
        running_daily_counts(log)
        .writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
