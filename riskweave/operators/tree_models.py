"""Forests, bagged trees, boosted trees and boosted stumps as Spark ML estimators over row blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.row_blocks import BINS, RowBlocks, leaving_out, row_blocks
from riskweave.operators.tree_boosting import WHOLE_BYTES, BoostSpec, StumpSpec, grow_boosted, grow_stumps
from riskweave.operators.tree_growth import LOCAL_ROWS, NODE, ForestSpec, grow_forest, importances, whole_tree

#: Bytes of trees that are broadcast at a time to score rows.
SCORED_BYTES = 1 << 26

MEAN, LOGIT, VOTE = "mean", "logit", "vote"


class _Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "codes per feature", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows of a node that one task finishes", TypeConverters.toInt)


class TreeEnsemble(Model, MLWritable):
    """Trees as a table of packed nodes, and how their leaves make a probability.

    ``mean`` averages them, ``logit`` adds them up in log odds, ``vote`` adds signed weights and passes twice their share of
    all weights through a sigmoid. Scoring reads the trees in batches of bounded size.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "what the leaves hold", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "weight per tree, of votes", TypeConverters.toListFloat)
    ranked = Param(Params._dummy(), "ranked", "importance per feature", TypeConverters.toListFloat)

    def __init__(self, trees: DataFrame | None = None, featuresCol: str = "features", kind: str = MEAN,
                 weights: Sequence[float] = (), ranked: Sequence[float] = ()):
        super().__init__()
        self.trees = trees
        self._set(featuresCol=featuresCol, kind=kind, weights=[float(w) for w in weights], ranked=[float(x) for x in ranked])

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.ranked))

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.ranked))

    def batches(self) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Numbered whole trees, some megabytes at a time."""
        sizes = self.trees.groupBy("tree").agg(F.sum(F.length("nodes")).alias("size")).orderBy("tree").collect()
        room, some = SCORED_BYTES, []
        for r in sizes:
            if some and r["size"] > room:
                yield self._read(some)
                room, some = SCORED_BYTES, []
            some.append(r["tree"])
            room -= r["size"]
        if some:
            yield self._read(some)

    def _read(self, numbers: list[int]) -> list[tuple[int, np.ndarray]]:
        found: dict[int, dict[int, bytes]] = {}
        for r in self.trees.where(F.col("tree").between(numbers[0], numbers[-1])).select("tree", "node", "nodes").collect():
            found.setdefault(r["tree"], {})[r["node"]] = bytes(r["nodes"])
        return [(t, whole_tree(pieces.pop(-1), pieces)) for t, pieces in sorted(found.items())]

    def total(self, spark: SparkSession, features: Column) -> Column:
        """The sum of the leaves that a row falls into, votes with their weights."""
        weights = self.getOrDefault(self.weights)
        terms = [leaf_sum(spark, [(weights[t] if weights else 1.0, nodes) for t, nodes in some])(features) for some in self.batches()]
        return sum(terms[1:], terms[0]) if terms else F.lit(0.0)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, weights = self.getOrDefault(self.kind), self.getOrDefault(self.weights)
        total = self.total(dataset.sparkSession, vector_to_array(self.getOrDefault(self.featuresCol)))
        scored = dataset.withColumn("_total", total)
        if kind == MEAN:
            p = F.col("_total") / max(self.trees.select("tree").distinct().count(), 1)
        else:
            p = 1 / (1 + F.exp(-F.col("_total") * (2 / sum(weights) if kind == VOTE else 1.0)))
        scored = scored.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        return scored.withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p", "_total")

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader()

    @classmethod
    def load(cls, path: str) -> TreeEnsemble:
        return cls.read().load(path)


class _EnsembleWriter(MLWriter):
    """Parameters as any stage, the trees as a Parquet table beside them."""

    def __init__(self, model: TreeEnsemble):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.trees.write.parquet(f"{path}/trees")


class _EnsembleReader(MLReader):
    def load(self, path: str) -> TreeEnsemble:
        model = TreeEnsemble(self.sparkSession.read.parquet(f"{path}/trees"))
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def leaf_sum(spark: SparkSession, trees: list[tuple[float, np.ndarray]]):
    """A function of the feature array: the weighted sum of the leaves that a row falls into."""
    handed = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def total(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 1)
        found = np.zeros(len(rows))
        for weight, nodes in handed.value:
            at, left = np.zeros(len(rows), np.int32), np.arange(len(rows))
            feature, cut, low, high = (nodes[c] for c in ("feature", "cut", "left", "right"))
            while len(left):
                inner = feature[at[left]] >= 0
                left = left[inner]
                node = at[left]
                at[left] = np.where(values[left, feature[node]] <= cut[node], low[node], high[node])
            found += weight * nodes["value"][at]
        return pa.array(found)

    return total


class _TreeEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """One model of all rows, or several that learn from parts of them and grow together."""

    def _fit(self, dataset: DataFrame) -> TreeEnsemble:
        return self.fit_members(dataset, None, 1)[0]

    def fit_folds(self, dataset: DataFrame, fold: str, folds: int, whole: bool = True) -> dict[int, TreeEnsemble]:
        """The models without one of the folds 1 to ``folds`` each, and with ``whole`` that of all rows as 0."""
        return self.fit_members(dataset, leaving_out(fold, folds), folds + 1, range(0 if whole else 1, folds + 1))

    def fit_members(
        self, dataset: DataFrame, members: Column | None, models: int, wanted: Sequence[int] | None = None
    ) -> dict[int, TreeEnsemble]:
        """``models`` models, or those ``wanted`` of them; bit m of ``members`` says whether model m learns from a row."""
        get = self.getOrDefault
        blocks = row_blocks(dataset, get(self.featuresCol), get(self.labelCol), members, models, get(self.bins))
        return self.grown(blocks, list(range(models) if wanted is None else wanted))

    def grown(self, blocks: RowBlocks, models: list[int]) -> dict[int, TreeEnsemble]:
        raise NotImplementedError

    def _ensemble(self, blocks: RowBlocks, trees: DataFrame, model: int, kind: str, weights: Sequence[float] = ()) -> TreeEnsemble:
        mine = trees.where(F.col("model") == model).drop("model")
        return TreeEnsemble(mine, self.getOrDefault(self.featuresCol), kind, weights, importances(mine, blocks.width))


class ForestClassifier(_TreeEstimator):
    """A forest or bagged trees: each tree on an exact number of draws with replacement and a share of the features.

    ``nodeFeatures``: features looked at per node, the root of their number if 0, all if negative. ``treeFeatures``: share of
    the features a tree may use. ``drawShare``: draws as a share of the rows. Trees are as deep as ``maxDepth`` allows.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    nodeFeatures = Param(Params._dummy(), "nodeFeatures", "features per node", TypeConverters.toInt)
    treeFeatures = Param(Params._dummy(), "treeFeatures", "share of features per tree", TypeConverters.toFloat)
    drawShare = Param(Params._dummy(), "drawShare", "draws per row", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "classes weigh the same", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", trees=300, nodeFeatures=0, treeFeatures=1.0, drawShare=1.0,
        maxDepth=1 << 30, balanced=False, seed=42, bins=BINS, localRows=LOCAL_ROWS,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", trees=300, nodeFeatures=0, treeFeatures=1.0, drawShare=1.0,
                         maxDepth=1 << 30, balanced=False, seed=42, bins=BINS, localRows=LOCAL_ROWS)
        self._set(**self._input_kwargs)

    def grown(self, blocks: RowBlocks, models: list[int]) -> dict[int, TreeEnsemble]:
        get = self.getOrDefault
        per_node = get(self.nodeFeatures)
        spec = ForestSpec(
            get(self.trees), max(1, int(get(self.treeFeatures) * blocks.width)),
            None if per_node < 0 else per_node or max(1, int(blocks.width ** 0.5)), get(self.drawShare), get(self.maxDepth),
            get(self.balanced), get(self.seed),
        )
        trees = grow_forest(blocks, spec, models, get(self.localRows))
        return {m: self._ensemble(blocks, trees, m, MEAN) for m in models}


class NewtonBoosting(_TreeEstimator):
    """Trees of gradients and Hessians of the logistic loss with Newton leaves, one histogram per feature and node.

    Every tree draws a share of the rows and of the features; rows of class 1 weigh ``count of 0 / count of 1``.
    """

    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows per tree", TypeConverters.toFloat)
    featureShare = Param(Params._dummy(), "featureShare", "share of features per tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", rounds=600, stepSize=0.05, maxDepth=6, rowShare=0.9, featureShare=0.9,
        seed=42, bins=BINS, localRows=32_768,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", rounds=600, stepSize=0.05, maxDepth=6, rowShare=0.9,
                         featureShare=0.9, seed=42, bins=BINS, localRows=32_768)
        self._set(**self._input_kwargs)

    def spec(self) -> BoostSpec:
        get = self.getOrDefault
        return BoostSpec(get(self.rounds), get(self.stepSize), get(self.maxDepth), get(self.rowShare), get(self.featureShare), get(self.seed))

    def grown(self, blocks: RowBlocks, models: list[int]) -> dict[int, TreeEnsemble]:
        trees = grow_boosted(blocks, self.spec(), models, self.getOrDefault(self.localRows), whole_bytes=WHOLE_BYTES)
        return {m: self._ensemble(blocks, trees, m, LOGIT) for m in models}


class BoostedStumps(_TreeEstimator):
    """Discrete two-class boosting of one-split trees: a round is one histogram of weighted class sums over fixed cuts."""

    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", rounds=100, seed=42, bins=256, localRows=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", rounds=100, seed=42, bins=256, localRows=0)
        self._set(**self._input_kwargs)

    def grown(self, blocks: RowBlocks, models: list[int]) -> dict[int, TreeEnsemble]:
        trees, weights = grow_stumps(blocks, StumpSpec(self.getOrDefault(self.rounds)), models)
        return {m: self._ensemble(blocks, trees, m, VOTE, weights[m]) for m in models}
