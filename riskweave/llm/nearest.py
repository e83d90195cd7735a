"""Nearest neighbours by a block matrix join: int8 tiles bound the products, survivors are recomputed, heaps merge."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.scratch import saved

#: Vectors of a query block and of a candidate block; a tile is one of each.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
#: Queries of a tile that are multiplied at once.
STRIP = 256
#: Candidate blocks whose results one merge takes at once; their merged runs meet in a second merge.
FAN = 64


class Quantised:
    """int8 rows with a scale each, and what rounding may change in a product."""

    def __init__(self, vectors: np.ndarray):
        self.exact = vectors
        self.scale = np.maximum(np.abs(vectors).max(axis=1), 1e-300) / 127
        codes = np.rint(vectors / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        self.norm = np.linalg.norm(vectors, axis=1)
        self.error = np.linalg.norm(vectors - codes * self.scale[:, None], axis=1)


def int8_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 sums of up to 1024 terms below 2^24 are exact."""
    total = np.zeros((len(x), len(y)))
    for a in range(0, x.shape[1], 1024):
        total += x[:, a : a + 1024].astype(np.float32) @ y[:, a : a + 1024].astype(np.float32).T
    return total


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def tile_nearest(queries: Quantised, query_ids: np.ndarray, block: Quantised, block_ids: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of each query's ``count`` nearest of the block, best first, ties to the smaller id.

    A product differs from its quantised form by at most |q| e_c + |c| e_q + e_q e_c, where e is the length of the
    rounding error. A candidate survives if its upper bound reaches the ``count``-th largest lower bound.
    """
    for a in range(0, len(query_ids), STRIP):
        rows = slice(a, a + STRIP)
        near = int8_products(queries.codes[rows], block.codes)
        near *= queries.scale[rows, None]
        near *= block.scale[None, :]
        slack = queries.norm[rows, None] * block.error + queries.error[rows, None] * (block.norm + block.error)
        slack += 1e-9 * (1 + queries.norm[rows, None] * block.norm)
        low = near - slack
        own = query_ids[rows, None] == block_ids[None, :]
        low[own] = -np.inf
        last = min(count, low.shape[1]) - 1  # only this place of the partition is sure to hold its value
        floor = -np.partition(-low, last, axis=1)[:, last]
        row, place = np.nonzero((near + slack >= floor[:, None]) & ~own)
        scores = exact_products(queries.exact[a + row], block.exact[place])
        order = np.lexsort((block_ids[place], -scores, row))
        row, place, scores = row[order], place[order], scores[order]
        edges = np.searchsorted(row, np.arange(len(near) + 1))
        for k, (first, last) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            last = min(last, first + count)
            yield a + k, block_ids[place[first:last]], scores[first:last]


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _merged(part: pa.Table, keys: list[str], count: int) -> pa.Table:
    """Heap merge of sorted runs of one query."""
    runs = [list(zip([-s for s in scores], ids)) for ids, scores in zip(part.column("ids").to_pylist(), part.column("scores").to_pylist())]
    best = list(islice(heapq.merge(*runs), count))
    columns = {k: part.column(k)[:1] for k in keys}
    return pa.table(columns | {
        "ids": pa.array([[i for _, i in best]], pa.list_(pa.int64())), "scores": pa.array([[-s for s, _ in best]], pa.list_(pa.float64())),
    })


def usable_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows with an id and a vector of finite, not null components, not all zero."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("raw"), finite.alias("finite"))
    return rows.filter("id is not null and raw is not null and finite").filter(
        F.exists("raw", lambda x: x != 0)
    ).select("id", F.col("raw").cast("array<double>").alias("v"))


def nearest(
    spark: SparkSession, rows: DataFrame, is_query: Column, count: int = 20, id_column: str = "vec_id",
    vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, its ``count`` nearest other rows.

    Nearness is the inner product in double precision; ranks start at 1, ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id; vectors of
    different lengths are only compared with those of their own. Of rows that share an id one vector is used, the
    least. A query with no other vector has no row; an empty table gives an empty result.

    Query and candidate vectors are dealt to blocks of bounded size by a hash of the id, within vectors of one
    length. Each tile of one query and one candidate block is a task's work, and hands on ``count`` rows a query; no
    block or tile depends on the values of the vectors.
    """
    keep = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_column, vector])], is_query.alias("wanted_query"))
    base = usable_vectors(keep, id_column, vector)
    asked = keep.filter("wanted_query").select(F.col(f"`{id_column}`").cast("long").alias("id")).distinct()
    base = base.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    base = saved(spark, base, "vectors")
    queries = base.join(asked, "id", "left_semi")
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a vector length
    n_queries = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, strips = F.lit(1), F.lit(1)
    for size in sizes:
        blocks = F.when(F.col("dim") == size["dim"], F.lit(-(-size["n"] // candidate_block))).otherwise(blocks)
        strips = F.when(F.col("dim") == size["dim"], F.lit(-(-n_queries.get(size["dim"], 0) // query_block))).otherwise(strips)
    blocks, strips = blocks.cast("long"), strips.cast("long")
    # each candidate goes to every query block, each query to every candidate block
    left = queries.select(
        "dim", F.pmod(F.xxhash64(F.lit("query"), "id"), strips).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("cb"),
        F.lit(True).alias("asks"), "id", "v",
    )
    right = base.filter(strips > 0).select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), strips - 1)).alias("qb"), F.pmod(F.xxhash64(F.lit("block"), "id"), blocks).alias("cb"),
        F.lit(False).alias("asks"), "id", "v",
    )

    def tile(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        ids, vectors = part.column("id").to_numpy(), _vectors(part, "v")
        found = list(tile_nearest(Quantised(vectors[asks]), ids[asks], Quantised(vectors[~asks]), ids[~asks], count)) if asks.any() and not asks.all() else []
        return pa.table({
            "query_id": pa.array([int(ids[asks][k]) for k, _, _ in found], pa.int64()),
            "fan": pa.array(np.full(len(found), part.column("cb")[0].as_py() // FAN), pa.int64()),
            "ids": pa.array([x.tolist() for _, x, _ in found], pa.list_(pa.int64())),
            "scores": pa.array([x.tolist() for _, _, x in found], pa.list_(pa.float64())),
        })

    runs = left.unionByName(right).groupBy("dim", "qb", "cb").applyInArrow(tile, "query_id long, fan long, ids array<long>, scores array<double>")
    if max([r["n"] for r in sizes], default=0) > candidate_block:
        runs = runs.groupBy("query_id", "fan").applyInArrow(
            lambda part: _merged(part, ["query_id", "fan"], count), "query_id long, fan long, ids array<long>, scores array<double>"
        )
    if max([r["n"] for r in sizes], default=0) > candidate_block * FAN:
        runs = runs.groupBy("query_id").applyInArrow(
            lambda part: _merged(part, ["query_id"], count), "query_id long, ids array<long>, scores array<double>"
        )
    return runs.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )
