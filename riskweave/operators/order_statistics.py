"""Exact order statistics without sorting a table or a group in one task.

``key_cuts`` finds the hash keys that close given ranks by descending a radix
histogram: every pass is one map-side combined count, and only bounded counter
rows reach the driver. ``medians_and_means`` does the same for numbers by counting
distinct values and accumulating those counts over value ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialised

HEX_KEY_LENGTH = 32
MAX_COUNTERS = 262_144
BUCKET_ROWS = 250_000


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons: a portable, repeatable shuffle key."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def key_cuts(
    keyed: DataFrame, group: str, key: str, ranks: Callable[[int], Sequence[int]], groups: int = 2
) -> dict[object, list[str]]:
    """For each group, largest keys such that ``at_or_below`` holds for exactly r rows.

    ``ranks`` maps a group's row count to ascending ranks r. Groups must be few
    (classes, repeats; ``MAX_COUNTERS`` counters in all, else an error); their
    sizes may be as skewed as they like. Rows that share one key cannot be
    separated and stay on the same side of a cut. ``groups`` is how many groups
    are expected; the first pass counts by as many digits as that allows.
    """
    depth = _digits(groups, HEX_KEY_LENGTH)
    counters = _count_prefixes(keyed, group, key, depth)
    sizes: dict[object, int] = {}
    for g, _, n in counters:
        sizes[g] = sizes.get(g, 0) + n
    wanted = {g: list(ranks(n)) for g, n in sizes.items()}
    cuts: dict[object, list[str]] = {g: [""] * len(rs) for g, rs in wanted.items()}
    # open searches: (group, known prefix) -> [(position, rank left inside prefix)]
    todo = {
        (g, ""): [(i, r) for i, r in enumerate(rs) if r > 0] for g, rs in wanted.items()
    }
    todo = _descend(counters, {k: v for k, v in todo.items() if v}, cuts, depth, depth)
    if todo:  # the few keys that share a prefix with a cut are written: later passes do not make all keys again
        keyed = materialised(keyed.where(_in_open_search(group, key, todo, depth)).select(group, key), "open-searches")
    while todo:
        width = _digits(len(todo), HEX_KEY_LENGTH - depth)
        inside = keyed.where(_in_open_search(group, key, todo, depth))
        depth += width
        counters = _count_prefixes(inside, group, key, depth)
        todo = _descend(counters, todo, cuts, depth, width)
    return cuts


def _count_prefixes(keyed: DataFrame, group: str, key: str, depth: int):
    counted = keyed.groupBy(group, F.substring(key, 1, depth).alias("prefix")).count()
    counters = counted.limit(4 * MAX_COUNTERS + 1).collect()
    if len(counters) > 4 * MAX_COUNTERS:
        raise ValueError(f"{group} has too many groups for counters on the driver")
    return counters


def _digits(open_searches: int, left: int) -> int:
    width = 1
    while width < left and open_searches * 16 ** (width + 1) <= MAX_COUNTERS:
        width += 1
    return width


def group_lookup(group: str, values: dict[object, list[str]]) -> Column:
    """The row's own group's text values as an array, from literals."""
    chain = F
    for value, texts in values.items():
        chain = chain.when(F.col(group).eqNullSafe(F.lit(value)), F.array(*[F.lit(t) for t in texts]))
    return chain


def _in_open_search(group: str, key: str, todo, depth: int) -> Column:
    prefixes: dict[object, list[str]] = {}
    for g, prefix in todo:
        prefixes.setdefault(g, []).append(prefix)
    return F.array_contains(group_lookup(group, prefixes), F.substring(key, 1, depth))


def _descend(counters, todo, cuts, depth: int, width: int):
    buckets: dict[object, list[tuple[str, int]]] = {}
    for g, prefix, n in counters:
        buckets.setdefault((g, prefix[: depth - width]), []).append((prefix, n))
    deeper: dict[tuple[object, str], list[tuple[int, int]]] = {}
    for (g, parent), searches in todo.items():
        ordered = sorted(buckets.get((g, parent), []))
        for position, rank in searches:
            seen = 0
            for prefix, n in ordered:
                if seen + n >= rank:
                    break
                seen += n
            if seen + n == rank or depth >= HEX_KEY_LENGTH:
                cuts[g][position] = prefix.ljust(HEX_KEY_LENGTH, "f")
            else:
                deeper.setdefault((g, prefix), []).append((position, rank - seen))
    return deeper


def at_or_below(key: Column, cut: Column | str) -> Column:
    """Whether a key ranks at or before a cut; the empty cut holds no rows."""
    return key <= cut


def running_totals(
    df: DataFrame,
    within: Sequence[str],
    order: str,
    measures: dict[str, str],
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Cumulative sums of ``measures`` along ``order`` inside each ``within`` group.

    ``df`` holds at most one row per (within, order) value and ``order`` is a
    double; it is computed once, into the shared folder. The axis is cut at
    quantiles into at least two buckets of about ``bucket_rows`` rows, every
    (group, bucket) accumulates in its own task, and the totals of the earlier
    buckets are added as offsets; so a group may be arbitrarily large.
    """
    df = materialised(df, "distinct-values")
    cuts = _axis_cuts(df, order, bucket_rows)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    keys = list(within)
    splits = [float("-inf"), *cuts, float("inf")]
    rank = F.col("_bucket") if not descending else -F.col("_bucket")
    bucketed = (
        Bucketizer(splits=splits, inputCol=order, outputCol="_bucket", handleInvalid="keep")
        .transform(df)
        .withColumn("_bucket", rank.cast("int"))
    )
    axis = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_bucket")
    before = axis.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
        .select(
            *[F.col(k).alias(f"_off_{k}") for k in keys],
            F.col("_bucket").alias("_off_bucket"),
            *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        )
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_off_{k}")) for k in keys],
        F.col("_bucket") == F.col("_off_bucket"),
    )
    local = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return bucketed.join(offsets, match).select(
        *df.columns,
        *[(F.sum(m).over(local) + F.col(f"_before_{m}")).alias(out) for m, out in measures.items()],
    )


def _axis_cuts(df: DataFrame, order: str, bucket_rows: int) -> list[float]:
    """Quantile cut points of the order axis, one at least; their digests are merged in a tree."""
    pieces = max(2, -(-df.count() // bucket_rows))
    shares = [i / pieces for i in range(1, pieces)]
    found = df.approxQuantile(order, shares, 1 / (10 * pieces))
    return sorted({cut for cut in found if math.isfinite(cut)}) or [0.0]


def medians_and_means(
    df: DataFrame, medians: Sequence[str], means: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values) and means of numeric columns.

    One pass over ``df`` counts each distinct value of the median columns and
    sums up the mean columns; the middle ranks are then read off the accumulated
    counts, so no task holds a whole column.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(c in medians).alias("ranked"))
            for c in dict.fromkeys([*medians, *means])
        ]
    )
    counts = (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("name", F.when(F.col("ranked"), F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .persist()
    )
    try:
        sizes = {
            r["name"]: r
            for r in counts.groupBy("name")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .collect()
        }
        found = {c: sizes[c]["total"] / sizes[c]["n"] for c in means if c in sizes}
        ranked = {c: sizes[c] for c in medians if c in sizes}
        if ranked:
            found |= _middle_values(counts, ranked, bucket_rows)
        return {c: found.get(c) for c in [*medians, *means]}
    finally:
        counts.unpersist()


def _middle_values(counts: DataFrame, sizes: dict, bucket_rows: int) -> dict[str, float]:
    ranked = running_totals(
        counts.where(F.col("value").isNotNull()).select("name", "value", "n"),
        ["name"],
        "value",
        {"n": "upto"},
        bucket_rows=bucket_rows,
    )
    first = F.col("upto") - F.col("n")

    def holds(name: str, rank: int) -> Column:
        return (F.col("name") == name) & (first < rank) & (F.col("upto") >= rank)

    wanted = [holds(c, rank) for c, r in sizes.items() for rank in {(r["n"] + 1) // 2, r["n"] // 2 + 1}]
    middle = (
        ranked.where(reduce(lambda a, b: a | b, wanted))
        .groupBy("name")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .collect()
    )
    return {r["name"]: (r["lo"] + r["hi"]) / 2 for r in middle}
