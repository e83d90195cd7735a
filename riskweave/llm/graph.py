"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.scratch import saved


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or the node itself)."""
    arcs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(arcs).select("u", F.least("u", "m").alias("m"))
    return (
        arcs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u != v").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    arcs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(arcs)
    others = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: label is the least node of its component.

    ``links``: two columns u, v of one orderable type without nulls; loops and repeats are allowed. Alternates large
    and small stars until the link table no longer changes, which takes a number of rounds that grows with the
    logarithm of the longest path. Each round aggregates minima before the shuffle, joins them to the links, and is
    written to the shared folder. No links: an empty table.
    """
    links = saved(spark, links.filter("u != v").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = state
        links = saved(spark, _small_star(_large_star(links)), "links")
