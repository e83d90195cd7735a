"""Column expressions for dates, ratios and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(col: Column) -> Column:
    """NaN compares greater than every number in Spark, so it never enters a rule."""
    return F.when(~F.isnan(col), col)


def parse_date(col: Column) -> Column:
    """Text to timestamp; text that is no date becomes null."""
    return F.try_to_timestamp(col)


def loan_month(col: Column) -> Column:
    """Calendar month of the loan as a category."""
    return F.month(col).cast("string")


def credit_age_months(col: Column, as_of: Column) -> Column:
    """Whole 30-day months between the loan date and ``as_of``."""
    return F.floor(F.datediff(as_of, col) / 30).cast("int")


def pct_change(value: Column, base: Column) -> Column:
    """Percentage change against ``base``; 0 where the base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(value - base, base) * 100)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; null where ``whole`` is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def as_day(col: Column) -> Column:
    return F.to_date(col)


def short_time(col: Column) -> Column:
    """Month-day and hour:minute."""
    return F.date_format(col, "MM-dd HH:mm")


def money(col: Column) -> Column:
    """Whole dollars with thousands separators."""
    return F.concat(F.lit("$"), F.format_number(col, 0))


def three_decimals(col: Column) -> Column:
    return F.when(col.isNotNull(), F.format_string("%.3f", col))
