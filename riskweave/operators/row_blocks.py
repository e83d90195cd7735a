"""Training rows as blocks of small integers: what the tree growers read again and again.

Each feature is cut at quantiles once, a row becomes one byte per feature, and a block of rows is one record. A row also
carries a mask of the models that learn from it, so that those of a cross-validation or a learning curve grow in the same
passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from riskweave.session import CLEANUP, materialised, scratch_path

BINS = 64
BLOCK_ROWS = 65_536
LAYOUT = "part int, seq int, n int, codes binary, labels binary, members binary"
#: Models that a mask has room for.
MOST_MODELS = 63


@dataclass
class Block:
    """One record: where it stands among all, its rows' codes (rows x features), labels and masks of models."""

    place: int
    codes: np.ndarray
    labels: np.ndarray
    members: np.ndarray

    def seen_by(self, model: int) -> np.ndarray:
        """The rows that a model learns from."""
        return np.flatnonzero(self.members >> model & 1)


@dataclass
class RowBlocks:
    """The blocks, the cuts of each feature, and how many rows each model learns from in every block and of each class."""

    table: DataFrame
    edges: list[np.ndarray]
    places: dict[tuple[int, int], int]
    sizes: np.ndarray  # blocks x models
    classes: np.ndarray  # models x 2

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @property
    def width(self) -> int:
        return len(self.edges)

    def reader(self):
        """What turns the record batches of a task into its blocks."""
        places, width = self.places, self.width

        def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[Block]:
            for part in parts:
                columns = [part.column(c).to_pylist() for c in ("part", "seq", "codes", "labels", "members")]
                for p, s, codes, labels, members in zip(*columns):
                    yield Block(
                        places[p, s], np.frombuffer(codes, np.uint8).reshape(-1, width),
                        np.frombuffer(labels, np.uint8), np.frombuffer(members, np.int64),
                    )

        return blocks


def quantile_cuts(df: DataFrame, features: str, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each feature: at most ``bins`` - 1 of its quantiles; a value's code is how many lie below it."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    first = df.select(F.size(vector_to_array(features)).alias("n")).first()
    names = [f"x{i}" for i in range(first["n"] if first else 0)]
    wide = df.select(vector_to_array(features).alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    found = wide.approxQuantile(names, [i / bins for i in range(1, bins)], 1 / (4 * bins)) if names else []
    return [np.unique(np.array(values, np.float64)) for values in found]


def leaving_out(fold: str, folds: int) -> Column:
    """The mask of a cross-validation: model 0 learns from every row, model k from those outside fold k."""
    everything = (1 << (folds + 1)) - 1
    return F.lit(everything) - F.expr(f"shiftleft(1L, cast(`{fold}` as int))")


def row_blocks(
    df: DataFrame, features: str, label: str, members: Column | None = None, models: int = 1, bins: int = BINS, block_rows: int = BLOCK_ROWS,
) -> RowBlocks:
    """The rows of ``df`` with a 0/1 label as blocks, written to the shared folder; ``members`` is the mask of ``models``
    models, bit by bit (null: one model learns from every row)."""
    if not 1 <= models <= MOST_MODELS:
        raise ValueError(f"between 1 and {MOST_MODELS} models can grow together")
    mask = (F.lit(1) if members is None else members).cast("long")
    rows = df.select(F.col(features).alias("features"), F.col(label).cast("int").alias("label"), mask.alias("member"))
    rows = materialised(rows.where(F.col("label").isNotNull()), "training-rows")
    edges = quantile_cuts(rows, "features", bins)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seq = TaskContext.get().partitionId(), 0
        for part in parts:
            values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            codes = np.empty(values.shape, np.uint8)
            for i, cuts in enumerate(edges):
                codes[:, i] = np.searchsorted(cuts, values[:, i])
            labels = part.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            masks = part.column("member").to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(codes), block_rows):
                some = slice(a, a + block_rows)
                columns = [pa.array([part_id], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(codes[some])], pa.int32()),
                           *[pa.array([x[some].tobytes()], pa.binary()) for x in (codes, labels, masks)]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n", "codes", "labels", "members"])
                seq += 1

    path = scratch_path(df.sparkSession, "row-blocks")
    rows.select(vector_to_array("features").alias("x"), "label", "member").mapInArrow(batches, LAYOUT).write.parquet(path)
    # hundreds of short passes follow, whose partitions are all given: nothing there to plan anew at run time
    passes = df.sparkSession.newSession()
    passes.conf.set("spark.sql.adaptive.enabled", "false")
    passes.conf.set(CLEANUP, "true")
    table = passes.read.schema(LAYOUT).parquet(path)

    def sizes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for labels, masks in zip(part.column("labels").to_pylist(), part.column("members").to_pylist()):
                label, mask = np.frombuffer(labels, np.uint8), np.frombuffer(masks, np.int64)
                found.append([int(((mask >> m & 1) * (label == k)).sum()) for m in range(models) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([part.column("part"), part.column("seq"), pa.array(found, pa.list_(pa.int64()))], names=["part", "seq", "sizes"])

    there: list[Row] = table.select("part", "seq", "labels", "members").mapInArrow(sizes, "part int, seq int, sizes array<long>").collect()
    there.sort(key=lambda r: (r["part"], r["seq"]))
    counts = np.array([r["sizes"] for r in there], np.int64).reshape(len(there), models, 2)
    return RowBlocks(table, edges, {(r["part"], r["seq"]): i for i, r in enumerate(there)}, counts.sum(axis=2), counts.sum(axis=0))
