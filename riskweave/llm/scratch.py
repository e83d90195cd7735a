"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import CLEANUP, scratch_path


def saved(spark: SparkSession, df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back; the shuffle files of the writing query go.

    ``path``: a path from ``scratch_path`` for a table that is to be discarded when its reader is done.
    """
    path = path or scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
