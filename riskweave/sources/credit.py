"""Readers of credit tables, scoring files and record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import null_if_nan
from riskweave.operators.validation import BROKEN, typed_records
from riskweave.schema import CORRUPT, CREDIT_SCHEMA, RAW_SCHEMA, REQUEST_COLUMNS


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating-point column."""
    doubles = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in doubles})


def load_credit(spark: SparkSession, path: str) -> DataFrame:
    """The credit table from Parquet, or from CSV when the path says so."""
    if path.endswith(".csv"):
        return read_scoring_file(spark, path).drop(BROKEN)
    return without_nan(spark.read.schema(CREDIT_SCHEMA).parquet(path))


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_with_snapshot(
    spark: SparkSession, read: Callable[[], DataFrame], snapshot: str, use_snapshot: bool = False
) -> DataFrame:
    """The snapshot if wanted and there; else the source, leaving a new snapshot behind."""
    if not (use_snapshot and _readable(spark, snapshot)):
        read().write.mode("overwrite").parquet(snapshot)
    return spark.read.parquet(snapshot)


def read_scoring_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header as typed records; bad values are listed, not fatal.

    The header decides which columns there are: an absent optional column is
    left out of the result rather than filled with null.
    """
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("the scoring file must be a .csv file")
    return typed_records(spark.read.option("header", True).csv(path))


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as typed records; keys may differ and absent ones are null."""
    raw = (
        spark.read.schema(RAW_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return typed_records(raw)


def read_records(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    """A list of request records as typed rows."""
    names = [f.name for f in RAW_SCHEMA if f.name != CORRUPT]
    rows = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records]
    return typed_records(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))


def present_fields(df: DataFrame) -> DataFrame:
    """Each record reduced to its non-null inputs, as JSON text in ``record``."""
    return df.withColumn("record", F.to_json(F.struct(*[c for c in REQUEST_COLUMNS if c in df.columns])))
