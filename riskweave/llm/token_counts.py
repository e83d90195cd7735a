"""Delta-maintained token totals: signed batches with idempotent commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


def word_count(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def signed(rows: DataFrame, sign: int, tokenizer: str, tokens: str) -> DataFrame:
    """Changes (source, lang, tokenizer, docs, tokens) that add (``sign`` 1) or take away (-1) each row's count."""
    return rows.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"),
        (F.col(f"`{tokens}`").cast("long") * sign).alias("tokens"),
    )


class TokenRollup:
    """Additive totals by source, language and tokenizer version in a folder that all executors share.

    Each batch is one partition of the delta table with its changes summed by group, and a row of zeros, so that a batch
    without changes has a partition too. Committing a batch writes its partition anew and touches no other, so a batch
    that is repeated after a lost executor, a crash or by mistake leaves the totals as they are. Totals are sums over all
    partitions; ``compact`` replaces many batches by one and keeps the names of all of them, which later commits ignore.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else None

    def _compacted(self) -> DataFrame:
        found = self._table("compacted", "batch string")
        return found if found is not None else self.spark.createDataFrame([], "batch string")

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Sets what ``batch`` adds to the totals; False, and nothing happens, if it has been compacted already, or if
        other batches have been compacted into one of that name.

        Changes have the columns of ``signed``; others are not read. Null sources and languages are groups of their own;
        null numbers count as zero; repeated rows count as often as they stand there. A batch without changes adds
        nothing, whatever it added when it was committed before.
        """
        if not self._compacted().filter(F.col("batch") == batch).isEmpty():
            return False
        whole = changes[0]
        for more in changes[1:]:
            whole = whole.unionByName(more)
        sums = whole.groupBy(*GROUPS).agg(
            F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
        )
        self._replace(sums.withColumn("batch", F.lit(batch)), [batch])
        return True

    def _replace(self, sums: DataFrame, batches: list[str]) -> None:
        """Writes the partitions of ``batches`` anew with the rows of ``sums`` and a row of zeros each, in one commit."""
        zeros = self.spark.createDataFrame([(None, None, None, 0, 0, b) for b in batches], DELTAS)
        sums.unionByName(zeros).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(
            f"{self.folder}/deltas")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of the groups that are not empty."""
        found = self._table("deltas", DELTAS)
        if found is None:
            found = self.spark.createDataFrame([], DELTAS)
        return found.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 or tokens != 0")

    def compact(self, into: str, batches: list[str]) -> None:
        """Replaces ``batches`` by one named ``into``, whose present rows are kept; batches never committed are left out.

        The names are put down before the partitions change, and the new partition is written in one commit with empty
        ones in place of the old, so that a crash in between leaves either state whole. Compacting again changes nothing.
        """
        deltas = self._table("deltas", DELTAS)
        if deltas is None:
            return
        mine = deltas.filter(F.col("batch").isin([*batches, into]))
        there = [r["batch"] for r in mine.select("batch").distinct().collect()]
        if not set(there) - {into}:
            return
        taken = sorted({*there, into})
        self.spark.createDataFrame([(b,) for b in taken], "batch string").write.mode("append").parquet(f"{self.folder}/compacted")
        sums = mine.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._replace(sums.withColumn("batch", F.lit(into)), taken)
