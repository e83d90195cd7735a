"""Typing and rule checks of incoming records, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.scalars import null_if_nan, parse_date
from riskweave.schema import BOUNDED_FIELDS, CORRUPT, KEY, REQUEST_FIELDS, REQUIRED_COLUMNS, TARGET

BROKEN = "broken_types"


def _typed(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return parse_date(text)
    if isinstance(dtype, T.IntegerType):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number).try_cast("int")
    if isinstance(dtype, T.DoubleType):
        return null_if_nan(text.try_cast("double"))
    return text.cast(dtype)


def typed_records(raw: DataFrame) -> DataFrame:
    """Text columns to declared types, listing the fields whose text does not fit.

    A date that cannot be read is only nulled: it is coerced, not rejected.
    """
    kinds = {f.name: f.dtype for f in REQUEST_FIELDS} | {KEY: T.LongType(), TARGET: T.IntegerType()}
    present = [c for c in raw.columns if c in kinds]
    numeric = [c for c in present if isinstance(kinds[c], (T.IntegerType, T.DoubleType))]
    broken = [
        F.when(
            F.col(c).isNotNull()
            & (F.lower(F.trim(c)) != "nan")
            & (F.trim(c) != "")
            & _typed(F.col(c), kinds[c]).isNull(),
            F.lit(f"type::{c}"),
        )
        for c in numeric
    ]
    if CORRUPT in raw.columns:
        broken.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("type::record")))
    return raw.select(
        *[
            (F.col(c).try_cast("long") if c == KEY else _typed(F.col(c), kinds[c])).alias(c)
            for c in present
        ],
        *[c for c in raw.columns if c not in kinds and c != CORRUPT],
        F.array_compact(F.array(*broken)).alias(BROKEN),
    )


def _rule_failures(columns: list[str]) -> dict[str, Column]:
    """Rule name to violation test, for the rules whose column is present."""
    rules = {}
    for field in BOUNDED_FIELDS:
        if field.name not in columns:
            continue
        value = F.col(field.name)
        if field.low is not None:
            rules[f"min::{field.name}"] = value < field.low
        if field.high is not None:
            rules[f"max::{field.name}"] = value > field.high
    return rules


def with_violations(df: DataFrame) -> DataFrame:
    """Append ``violations``: names of all rules a record breaks; nulls break none."""
    failed = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in _rule_failures(df.columns).items()])
    )
    if BROKEN in df.columns:
        failed = F.concat(F.col(BROKEN), failed)
    return df.withColumn("violations", failed).drop(BROKEN)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and rejected ones with their ``violations``."""
    checked = with_violations(df)
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def check_results(df: DataFrame, dataset: str = "credit") -> DataFrame:
    """One row per check: required columns, then every rule over the whole table."""
    columns = df.columns
    required = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(f"required::{name}").alias("check"),
            F.lit(name in columns).alias("ok"),
            F.lit(f"{name} {'exists' if name in columns else 'MISSING'}").alias("message"),
        )
        for name in REQUIRED_COLUMNS
    ]
    rules = _rule_failures(columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(test, 1)).alias(name) for name, test in rules.items()],
    )
    ruled = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(name).alias("check"),
            (F.col(f"`{name}`") == 0).alias("ok"),
            F.concat_ws(" ", F.col(f"`{name}`").cast("string"), F.lit("rows violate"), F.lit(name)).alias("message"),
        )
        for name in rules
    ]
    return counts.select(F.inline(F.array(*required, *ruled)))


def failing_checks(results: DataFrame, limit: int = 30) -> DataFrame:
    """The first failing checks by name."""
    return results.where(~F.col("ok")).orderBy("dataset", "check").limit(limit)


def check_totals(results: DataFrame) -> DataFrame:
    """Number of checks and of failures."""
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count(F.when(~F.col("ok"), 1)).alias("failures"),
    )


def missing_required(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def require_columns(df: DataFrame) -> None:
    """Fail early when a column the feature stages need is absent."""
    missing = missing_required(df)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
