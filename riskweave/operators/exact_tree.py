"""A decision tree with exact splits of any depth: counts by value ranges and attribute lists while nodes are large, sorted columns when small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.order_statistics import running_totals
from riskweave.operators.tree_growth import HISTOGRAM_BYTES, LOCAL_ROWS, TREES, ForestSpec, Top, finish, purity, rows_by_node, split_gains
from riskweave.operators.tree_models import MEAN, TreeEnsemble, importances
from riskweave.session import materialised

#: Ranges of values that a large node's rows are counted by.
RANGES = 256


class ExactTree(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gini splits half-way between neighbouring values, no binning; classes weigh the same if ``balanced``.

    A node of more than ``localRows`` rows is counted by value ranges first. A split's gain is convex in the class counts to
    its left, so the corners of what a range can hold bound the gains inside it (``open_ranges``). Only ranges that may hold the
    best split are listed value by value, with class counts accumulated (``running_totals``): no task holds a node or a feature,
    and what is shuffled does not grow with the rows of a level. One pass serves all large nodes of a level. Smaller nodes go
    to one task each, which finishes their subtree.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "classes weigh the same", TypeConverters.toBoolean)
    localRows = Param(Params._dummy(), "localRows", "rows of a node that one task finishes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", maxDepth=1 << 30, balanced=False, localRows=LOCAL_ROWS):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxDepth=1 << 30, balanced=False, localRows=LOCAL_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreeEnsemble:
        get = self.getOrDefault
        label = F.col(get(self.labelCol)).cast("int")
        rows = dataset.where(label.isNotNull()).select(vector_to_array(get(self.featuresCol)).alias("x"), label.alias("label"))
        rows = materialised(rows, "tree-rows")
        counts = np.zeros(2, np.int64)
        for r in rows.groupBy("label").count().collect():
            counts[r["label"]] = r["count"]
        if not counts.sum():
            raise ValueError("no labelled rows")
        width = rows.select(F.size("x").alias("n")).first()["n"]
        weights = counts.sum() / (2 * np.maximum(counts, 1)) if get(self.balanced) else np.ones(2)
        spec = ForestSpec(1, depth=get(self.maxDepth))
        top = Top(0, int(counts.sum()))
        top.counts[0] = counts
        if (counts == 0).any() or spec.depth < 1:
            top.open.clear()
        large = [n for n in top.open if top.sizes[n] > get(self.localRows)]
        cuts = value_ranges(rows, width) if large else []
        while large:
            found = {r["node"]: r for r in best_exact_splits(rows, top, large, cuts, weights).collect()}
            for n in large:
                r = found.get(n)
                if r is None:  # all rows alike
                    top.open.discard(n)
                else:
                    top.split(n, r["feature"], r["cut"], r["gain"], np.array([r["l0"], r["l1"]]), top.counts[n], spec.depth)
            large = [n for n in sorted(top.open) if top.sizes[n] > get(self.localRows)]
        trees = rows.sparkSession.createDataFrame([(0, -1, top.nodes(weights, lambda f, cut, _: cut).tobytes())], "tree int, node int, nodes binary")
        if top.open:
            trees = trees.unionByName(materialised(_finished(rows, top, spec, weights, width), "subtrees").drop("model"))
        return TreeEnsemble(trees, get(self.featuresCol), MEAN, (), importances(trees, width))


def value_ranges(rows: DataFrame, width: int, ranges: int = RANGES) -> list[np.ndarray]:
    """Ascending cuts of each feature near its quantiles; a value's range is how many cuts lie below it."""
    names = [f"x{i}" for i in range(width)]
    wide = rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    found = wide.approxQuantile(names, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if names else []
    return [np.unique(np.array(values, np.float64)) for values in found]


def _large_rows(rows: DataFrame, top: Top, nodes: list[int]):
    """What a task reads: values, labels and places in ``nodes`` of the rows that lie in one of them."""
    handed = rows.sparkSession.sparkContext.broadcast((top, nodes))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        top, nodes = handed.value
        number = np.full(len(top.feature), -1)
        number[nodes] = np.arange(len(nodes))
        for part in parts:
            if part.num_rows:
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                place = number[top.routed(x)]
                inside = np.flatnonzero(place >= 0)
                yield x[inside] + 0.0, part.column("label").to_numpy(zero_copy_only=False)[inside].astype(np.int64), place[inside]

    return read


def open_ranges(counts: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(feature, range, rows of class 0 and 1 below it) of the ranges of a node (features x ranges x classes) that may hold its
    best split or one as good."""
    upto = np.cumsum(counts, axis=1)
    below, whole = upto - counts, upto[:, -1:, :]
    gains = split_gains(upto, whole - upto, weights)
    best = gains.max(initial=0.0)
    corners = np.stack([below, upto, np.stack([below[..., 0], upto[..., 1]], -1), np.stack([upto[..., 0], below[..., 1]], -1)])
    bound = (purity(corners, weights) + purity(whole - corners, weights) - purity(whole, weights)).max(axis=0)
    room = 1e-9 * float(counts[:1].sum() * weights.max())  # rounding
    return [(f, r, *below[f, r].tolist()) for f, r in np.argwhere((bound >= best - room) & (counts.sum(axis=2) > 0)).tolist()]


def ranges_to_list(rows: DataFrame, top: Top, nodes: list[int], cuts: list[np.ndarray], weights: np.ndarray) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Rows below, by class, of each (node, feature, range) to be listed; the counts are added up per node."""
    read, ranges, width = _large_rows(rows, top, nodes), max([1, *map(len, cuts)]) + 1, len(cuts)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(nodes), width, ranges * 2), np.int64)
        for x, label, place in read(parts):
            for f in range(width):
                cell = (place * ranges + np.searchsorted(cuts[f], x[:, f])) * 2 + label
                held[:, f] += np.bincount(cell, minlength=len(nodes) * ranges * 2).reshape(len(nodes), -1)
        there = np.flatnonzero(held.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in there], pa.int32()), pa.array([held[i].tobytes() for i in there], pa.binary())], names=["node", "raw"])

    def opened(key: tuple, table: pa.Table) -> pa.Table:
        found = open_ranges(sum(np.frombuffer(raw, np.int64) for raw in table.column("raw").to_pylist()).reshape(width, ranges, 2), weights)
        columns = list(zip(*found)) or [[]] * 4
        return pa.table({"node": pa.array([key[0].as_py()] * len(found), pa.int32()),
                         **{c: pa.array(v, pa.int64()) for c, v in zip(("feature", "range", "b0", "b1"), columns)}})

    summed = rows.mapInArrow(counted, "node int, raw binary").groupBy("node").applyInArrow(opened, "node int, feature long, range long, b0 long, b1 long")
    return {(r["node"], r["feature"], r["range"]): (r["b0"], r["b1"]) for r in summed.collect()}


def attribute_lists(rows: DataFrame, top: Top, nodes: list[int], cuts: list[np.ndarray], wanted: dict[tuple[int, int, int], tuple[int, int]]) -> DataFrame:
    """(node, feature, range, value, n0, n1): the distinct values in the wanted ranges, with their class counts."""
    read, ranges = _large_rows(rows, top, nodes), max([1, *map(len, cuts)]) + 1
    listed = np.zeros((len(nodes), len(cuts), ranges), bool)
    for n, f, r in wanted:
        listed[nodes.index(n), f, r] = True
    handed, ids = rows.sparkSession.sparkContext.broadcast(listed), np.array(nodes, np.int32)

    def lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = handed.value
        for x, label, place in read(parts):
            for f in np.flatnonzero(listed.any(axis=(0, 2))).tolist():
                within = np.searchsorted(cuts[f], x[:, f])
                some = np.flatnonzero(listed[place, f, within])
                if len(some):
                    keys = np.column_stack([place[some].astype(np.float64), within[some].astype(np.float64), x[some, f]])
                    keys, at = np.unique(keys, axis=0, return_inverse=True)
                    counts = [np.bincount(at.ravel(), label[some] == k, len(keys)).astype(np.int64) for k in (0, 1)]
                    columns = [ids[keys[:, 0].astype(np.int64)], np.full(len(keys), f, np.int32), keys[:, 1].astype(np.int32), keys[:, 2], *counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "feature", "range", "value", "n0", "n1"])

    long = rows.mapInArrow(lists, "node int, feature int, range int, value double, n0 long, n1 long")
    return long.groupBy("node", "feature", "range", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def next_values(rows: DataFrame, top: Top, best: dict[int, tuple[int, float]]) -> DataFrame:
    """(node, high): the least value of the node's feature above the given one."""
    nodes = sorted(best)
    read, features, lows = _large_rows(rows, top, nodes), np.array([best[n][0] for n in nodes]), np.array([best[n][1] for n in nodes])

    def above(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.full(len(nodes), np.inf)
        for x, _, place in read(parts):
            value = x[np.arange(len(place)), features[place]]
            more = value > lows[place]
            np.minimum.at(high, place[more], value[more])
        there = np.flatnonzero(np.isfinite(high))
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in there], pa.int32()), pa.array(high[there])], names=["node", "high"])

    return rows.mapInArrow(above, "node int, high double").groupBy("node").agg(F.min("high").alias("high"))


def _purity(a: Column, b: Column, weights: np.ndarray) -> Column:
    x, y = a * F.lit(float(weights[0])), b * F.lit(float(weights[1]))
    return (x * x + y * y) / (x + y)


def best_exact_splits(rows: DataFrame, top: Top, nodes: list[int], cuts: list[np.ndarray], weights: np.ndarray) -> DataFrame:
    """(node, feature, cut, gain, l0, l1) of each node that a feature parts; ties to the first feature and value.

    The cut lies half-way between the value and the next one that occurs in the node.
    """
    step = max(1, HISTOGRAM_BYTES // max(1, len(cuts) * (max([1, *map(len, cuts)]) + 1) * 16))
    wanted: dict[tuple[int, int, int], tuple[int, int]] = {}
    for a in range(0, len(nodes), step):
        wanted |= ranges_to_list(rows, top, nodes[a : a + step], cuts, weights)
    upto = running_totals(attribute_lists(rows, top, nodes, cuts, wanted), ["node", "feature", "range"], "value", {"n0": "u0", "n1": "u1"})
    below = rows.sparkSession.createDataFrame([(*k, *v) for k, v in wanted.items()], "node int, feature int, range int, b0 long, b1 long")
    upto = upto.join(below, ["node", "feature", "range"]).withColumns({"l0": F.col("u0") + F.col("b0"), "l1": F.col("u1") + F.col("b1")})
    whole0, whole1 = (F.lit([int(c[k]) if c is not None else 0 for c in top.counts])[F.col("node")] for k in (0, 1))
    r0, r1 = whole0 - F.col("l0"), whole1 - F.col("l1")
    gain = _purity(F.col("l0"), F.col("l1"), weights) + _purity(r0, r1, weights) - _purity(F.col("l0") + r0, F.col("l1") + r1, weights)
    gains = upto.where(r0 + r1 > 0).select("node", "feature", "value", "l0", "l1", gain.alias("gain"))
    order = F.struct("gain", -F.col("feature"), -F.col("value"))
    best = gains.groupBy("node").agg(F.max_by(F.struct("feature", "value", "gain", "l0", "l1"), order).alias("best")).select("node", "best.*")
    best = materialised(best, "best-splits")
    after = next_values(rows, top, {r["node"]: (r["feature"], r["value"]) for r in best.collect()})
    middle = F.col("value") / 2 + F.col("high") / 2
    cut = F.when(middle >= F.col("high"), F.col("value")).otherwise(middle)
    return best.join(after, "node").select("node", "feature", cut.alias("cut"), "gain", "l0", "l1")


def _finished(rows: DataFrame, top: Top, spec: ForestSpec, weights: np.ndarray, width: int) -> DataFrame:
    handed = rows.sparkSession.sparkContext.broadcast(top)

    def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = handed.value
        for part in parts:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
            at = top.routed(x)
            there = rows_by_node(at, top.open, len(top.feature))
            columns = [pa.array([n for n, _ in there], pa.int32()), *[pa.array([v[mine].tobytes() for _, mine in there], pa.binary()) for v in (x, label)]]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "x", "labels"])

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        top, node = handed.value, key[0].as_py()
        x, labels = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("x", np.float64), ("labels", np.uint8)))
        x = x.reshape(-1, width)
        counts = np.zeros((len(labels), 2), np.int64)
        counts[np.arange(len(labels)), labels] = 1
        ranked = [np.unique(x[:, f], return_inverse=True) for f in range(width)]
        codes = np.column_stack([place.ravel().astype(np.int32) for _, place in ranked])

        def middle(features: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
            low, high = np.empty(len(features)), np.empty(len(features))
            for f in np.unique(features).tolist():
                low[features == f], high[features == f] = ranked[f][0][at[features == f]], ranked[f][0][after[features == f]]
            half = low / 2 + high / 2
            return np.where(half >= high, low, half)

        made = finish(codes, counts, 0, top.depth[node], np.arange(width), spec, weights, middle)
        return pa.table({"model": pa.array([0], pa.int32()), "tree": pa.array([0], pa.int32()), "node": pa.array([node], pa.int32()), "nodes": pa.array([made.tobytes()], pa.binary())})

    tasks = max(1, min(len(top.open), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    packed = rows.mapInArrow(sent, "node int, x binary, labels binary")
    return packed.repartition(tasks, "node").groupBy("node").applyInArrow(grown, TREES)


def described_splits(model: TreeEnsemble) -> DataFrame:
    """(node, place, cut, gain) of every split: the way from the root as L and R, the feature's place, the threshold and
    the Gini decrease."""
    ((_, nodes),) = [t for some in model.batches() for t in some]
    rows, waiting = [], [("", 0)]
    for way, at in waiting:
        if nodes["feature"][at] >= 0:
            rows.append((way, int(nodes["feature"][at]), float(nodes["cut"][at]), float(nodes["gain"][at])))
            waiting += [(way + "L", int(nodes["left"][at])), (way + "R", int(nodes["right"][at]))]
    found = model.trees.sparkSession.createDataFrame(rows, "node string, place int, cut double, gain double")
    return found.withColumns({"cut": F.round("cut", 6), "gain": F.round("gain", 4)})
