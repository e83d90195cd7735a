"""The append-only prediction log: a Parquet table partitioned by day and batch.

A batch rewrites only its own (day, batch) partitions, so a retried append
never duplicates rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.scalars import as_day
from riskweave.schema import KEY, LOGGED_FEATURES, PREDICTION_LOG_SCHEMA, REQUEST_COLUMNS

DAY = "log_date"
BATCH = "batch"

LOG_TABLE_SCHEMA = T.StructType(
    [*PREDICTION_LOG_SCHEMA, T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.StringType())]
)


def as_timestamp(value: str | datetime) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def moment(df: DataFrame, column: str, value: str | datetime) -> Column:
    """A literal of the column's own timestamp type, so that filters reach the scan."""
    return F.lit(as_timestamp(value).isoformat(sep=" ")).cast(df.schema[column].dataType)


def create_log(spark: SparkSession, table: str, location: str | None = None) -> None:
    """Create the log table unless it exists."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PREDICTION_LOG_SCHEMA)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {DAY} date, {BATCH} string) "
        f"USING parquet PARTITIONED BY ({DAY}, {BATCH}){place}"
    )


def inputs_json(columns: list[str]) -> Column:
    """The record's inputs as JSON text; null fields are left out."""
    return F.to_json(F.struct(*[c for c in REQUEST_COLUMNS if c in columns]))


def log_rows(scored: DataFrame, logged_at: str | datetime | None = None) -> DataFrame:
    """Scored records in log form, with defaults for missing results.

    The id is made of the record's key, the time and the inputs; records without a
    key column are refused, as equal ones could not be told apart.
    """
    columns = scored.columns
    if KEY not in columns:
        raise ValueError(f"the log needs the record key {KEY}")

    def of(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)

    if logged_at is not None:
        at = F.lit(as_timestamp(logged_at).isoformat(sep=" ")).cast("timestamp")
    elif "timestamp" in columns:
        at = F.col("timestamp").cast("timestamp")
    else:
        raise ValueError("the log needs a time: logged_at or a column timestamp, so that a retry on another day replaces the batch")
    shaped = scored.select(
        at.alias("timestamp"),
        inputs_json(columns).alias("input_data"),
        of("prediction", 0).cast("int").alias("prediction"),
        of("probability", 0.5).cast("double").alias("probability"),
        of("risk_level", "Unknown").alias("risk_level"),
        *[
            (F.col(c) if c in columns else F.lit(None)).cast(PREDICTION_LOG_SCHEMA[c].dataType).alias(c)
            for c in LOGGED_FEATURES
        ],
        F.concat(F.coalesce(F.col(KEY).cast("string"), F.lit("")), F.lit(":")).alias("_identity"),
    )
    identifier = F.md5(F.concat_ws("|", "_identity", F.col("timestamp").cast("string"), "input_data"))
    return shaped.select(identifier.alias("id"), *[f.name for f in PREDICTION_LOG_SCHEMA if f.name != "id"])


def _batch_rows(scored: DataFrame, batch: str, logged_at: str | datetime | None) -> DataFrame:
    return (
        log_rows(scored, logged_at)
        .withColumn(DAY, as_day(F.col("timestamp")))
        .withColumn(BATCH, F.lit(batch))
    )


def append_predictions(
    scored: DataFrame, location: str, batch: str, logged_at: str | datetime | None = None
) -> None:
    """Append one named batch to the log's files; the same batch again replaces it."""
    (
        _batch_rows(scored, batch, logged_at)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, BATCH)
        .parquet(location)
    )


def insert_predictions(
    scored: DataFrame, table: str, batch: str, logged_at: str | datetime | None = None
) -> None:
    """The same for a table made by ``create_log``."""
    (
        _batch_rows(scored, batch, logged_at)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .insertInto(table)
    )


def read_log(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(LOG_TABLE_SCHEMA).parquet(location)


def recent_log(log: DataFrame, days: int, as_of: str | datetime) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; prunes day partitions if there are any."""
    end = as_timestamp(as_of)
    start = end - timedelta(days=days)
    at = F.col("timestamp")
    kept = log.where((at >= moment(log, "timestamp", start)) & (at < moment(log, "timestamp", end)))
    if DAY in log.columns:
        kept = kept.where(F.col(DAY).between(F.lit(start.date()), F.lit(end.date())))
    return kept


def newest_first(log: DataFrame, days: int, as_of: str | datetime) -> DataFrame:
    return recent_log(log, days, as_of).orderBy(F.desc("timestamp"), "id")


def parsed_inputs(log: DataFrame, schema: str) -> DataFrame:
    """The logged JSON inputs as columns again."""
    return log.select("id", F.from_json("input_data", schema).alias("inputs")).select("id", "inputs.*")
