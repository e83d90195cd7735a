"""Seeded splits, folds and nested samples as plain filters on a hash key.

Membership depends only on the row's id and the seed. The exact sizes come from
``key_cuts``, so no row is sorted or moved to decide where it belongs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.order_statistics import at_or_below, group_lookup, hash_key, key_cuts
from riskweave.schema import KEY, TARGET
from riskweave.session import materialised


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _with_key(df: DataFrame, key: Column) -> DataFrame:
    """Hash once per row; later expressions refer to the column."""
    return df.withColumn("_key", key)


def mark_test_rows(
    df: DataFrame, label: str = TARGET, key: str = KEY, share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Append ``is_test``: exactly round(share * n) rows of every class."""
    shuffled = hash_key(F.col(key), seed)
    narrow = materialised(df.select(label, shuffled.alias("_key")), "keys")
    cuts = key_cuts(narrow, label, "_key", lambda n: [_half_up(share * n)])
    if not cuts:
        return df.withColumn("is_test", F.lit(False))
    return df.withColumn("is_test", at_or_below(shuffled, group_lookup(label, cuts)[0]))


def stratified_split(
    df: DataFrame, label: str = TARGET, key: str = KEY, share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts with equal class shares."""
    marked = mark_test_rows(df, label, key, share, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def fold_ends(n: int, k: int) -> list[int]:
    """Last rank of each of the first k-1 folds; sizes differ by at most one."""
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [sum(sizes[: i + 1]) for i in range(k - 1)]


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = TARGET, key: str = KEY, seed: int = 42
) -> DataFrame:
    """Append ``fold`` 1..k, balanced inside every class."""
    shuffled = hash_key(F.col(key), seed)
    narrow = materialised(df.select(label, shuffled.alias("_key")), "keys")
    cuts = key_cuts(narrow, label, "_key", lambda n: fold_ends(n, k))
    if not cuts:
        return df.withColumn("fold", F.lit(1))

    if k == 1:
        return df.withColumn("fold", F.lit(1))
    ends = F.col("_ends")
    chain = F
    for fold in range(1, k):
        chain = chain.when(at_or_below(F.col("_key"), ends[fold - 1]), F.lit(fold))
    keyed = _with_key(df, shuffled).withColumn("_ends", group_lookup(label, cuts))
    return keyed.withColumn("fold", chain.otherwise(F.lit(k))).drop("_key", "_ends")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores before each is copied many times in place, if fewer partitions than cores hold them.

    The copies are only counted, never shuffled, so the narrow rows are what
    moves. Hashing by key keeps a recomputed partition identical.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def repeated(df: DataFrame, repeats: int, key: str = KEY, seed: int = 123) -> DataFrame:
    """One copy of the rows per repeat, each with the ``_key`` that orders that repeat."""
    copies = spread(df, key).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return _with_key(copies, hash_key(F.col(key), F.col("repeat"), seed))


def test_size(n: int, share: float) -> int:
    return math.ceil(share * n)


def shuffle_splits(
    df: DataFrame, repeats: int = 50, share: float = 0.2, key: str = KEY, seed: int = 123
) -> DataFrame:
    """One copy of the rows per repeat, each with its own random test part."""
    keys = materialised(df.select(key), "keys")
    cuts = key_cuts(repeated(keys, repeats, key, seed), "repeat", "_key", lambda n: [test_size(n, share)], repeats)
    copies = repeated(df, repeats, key, seed)
    is_test = at_or_below(F.col("_key"), group_lookup("repeat", cuts)[0])
    return copies.withColumn("is_test", is_test).drop("_key")


def sample_ranks(n: int, fractions: list[float]) -> list[int]:
    """Row counts of nested samples, at least one row each."""
    return [max(1, int(f * n)) for f in fractions]
