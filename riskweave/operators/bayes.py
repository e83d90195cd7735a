"""Gaussian naive Bayes in closed form: one pass of mergeable moments, log densities as a column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Fixed value: share of the largest variance that is added to all, so that none is zero.
VARIANCE_FLOOR = 1e-9


class _Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    floor = Param(Params._dummy(), "floor", "share of the largest variance added to all", TypeConverters.toFloat)


class GaussianBayes(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Each class's share, and mean and population variance of every feature, from one aggregation.

    Spark merges the moments of partitions, so rows are read once and only two rows of moments reach the driver. To each
    variance comes ``floor`` times the largest variance that a feature has over all rows.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", floor=VARIANCE_FLOOR):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", floor=VARIANCE_FLOOR)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> GaussianBayesModel:
        return self.fit_members(dataset, F.lit(1), 1)[0]

    def fit_members(self, dataset: DataFrame, members: Column, models: int) -> dict[int, GaussianBayesModel]:
        """``models`` models; bit m of ``members`` says whether model m learns from a row.

        Rows of one mask are rolled up together, so one pass serves all models; the masks are few where models learn from
        folds and nested samples.
        """
        features, label = self.getOrDefault(self.featuresCol), self.getOrDefault(self.labelCol)
        first = dataset.select(F.size(vector_to_array(features)).alias("n")).first()
        width = range(first["n"] if first else 0)
        rows = dataset.where(F.col(label).isNotNull()).select(
            members.cast("long").alias("member"), F.col(label).cast("int").alias("label"), vector_to_array(features).alias("x")
        )
        found = rows.groupBy("member", "label").agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(F.col("x")[i]) for i in width]).alias("means"),
            F.array(*[F.var_pop(F.col("x")[i]) for i in width]).alias("variances"),
        ).collect()
        found.sort(key=lambda r: (r["member"], r["label"]))
        return {m: self._model([r for r in found if r["member"] >> m & 1], width) for m in range(models)}

    def _model(self, found: list, width: range) -> GaussianBayesModel:
        """The model of some (mask, class) rows of moments."""
        classes: dict[int, dict] = {}
        for r in found:
            seen = classes.get(r["label"])
            classes[r["label"]] = r.asDict() if seen is None else merged_moments(seen, r)
        if set(classes) != {0, 1}:
            raise ValueError("both classes are needed")
        counts = [classes[k]["n"] for k in (0, 1)]
        shares = [n / sum(counts) for n in counts]
        largest = 0.0
        for i in width:
            mean = sum(s * classes[k]["means"][i] for k, s in enumerate(shares))
            whole = sum(s * (classes[k]["variances"][i] + (classes[k]["means"][i] - mean) ** 2) for k, s in enumerate(shares))
            largest = max(largest, whole)
        more = self.getOrDefault(self.floor) * largest
        return GaussianBayesModel(
            featuresCol=self.getOrDefault(self.featuresCol), shares=shares, means=[m for k in (0, 1) for m in classes[k]["means"]],
            variances=[v + more for k in (0, 1) for v in classes[k]["variances"]],
        )


def merged_moments(a: dict, b: Row | dict) -> dict:
    """Count, means and population variances of two sets of rows together."""
    n = a["n"] + b["n"]
    means, variances = [], []
    for p, q, u, v in zip(a["means"], b["means"], a["variances"], b["variances"]):
        means.append(p + (q - p) * (b["n"] / n))
        variances.append((u * a["n"] + v * b["n"] + (q - p) * (q - p) * (a["n"] / n) * b["n"]) / n)
    return {"n": n, "means": means, "variances": variances}


class GaussianBayesModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Appends rawPrediction (joint log likelihoods), probability and prediction."""

    shares = Param(Params._dummy(), "shares", "share of each class", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means of class 0, then of class 1", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "variances in the same order", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", shares=None, means=None, variances=None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.means)) // 2

    def log_likelihood(self, x: Column, label: int) -> Column:
        """Log of the class's share and of the densities of all features."""
        n = self.numFeatures
        moments = [self.getOrDefault(p)[label * n : label * n + n] for p in (self.means, self.variances)]
        constant = math.log(self.getOrDefault(self.shares)[label]) - 0.5 * sum(math.log(2 * math.pi * v) for v in moments[1])
        squares = [(x[i] - m) * (x[i] - m) * (0.5 / v) for i, (m, v) in enumerate(zip(*moments))]
        return F.lit(constant) - reduce(lambda a, b: a + b, squares, F.lit(0.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getOrDefault(self.featuresCol))
        scored = dataset.withColumn("_logs", F.array(self.log_likelihood(x, 0), self.log_likelihood(x, 1)))
        # the share of class 1 from the difference alone: neither exponential can overflow
        p = 1 / (1 + F.exp(F.col("_logs")[0] - F.col("_logs")[1]))
        return scored.withColumns({
            "rawPrediction": array_to_vector("_logs"),
            "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (F.col("_logs")[1] > F.col("_logs")[0]).cast("double"),
        }).drop("_logs")


def predicted_together(models: Sequence[GaussianBayesModel], features: Column) -> Column:
    """What each of several models predicts of a row, as an array: the rows are read once for all of them."""
    terms = []
    for model in models:
        n, shares, means, variances = model.numFeatures, *(model.getOrDefault(p) for p in (model.shares, model.means, model.variances))
        halves = [(means[k * n : k * n + n], variances[k * n : k * n + n]) for k in (0, 1)]
        constants = [math.log(shares[k]) - 0.5 * sum(math.log(2 * math.pi * v) for v in halves[k][1]) for k in (0, 1)]
        terms.append([(c, m, [0.5 / x for x in v]) for c, (m, v) in zip(constants, halves)])

    @F.arrow_udf("array<int>")
    def predicted(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
        by_feature = np.ascontiguousarray(x.T)
        found = np.empty((len(rows), len(terms)), np.int32)
        for j, classes in enumerate(terms):
            logs = []
            for constant, means, factors in classes:
                total = np.zeros(len(rows))
                for values, mean, factor in zip(by_feature, means, factors):
                    away = values - mean
                    total += away * away * factor
                logs.append(constant - total)
            found[:, j] = logs[1] > logs[0]
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(terms))
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return predicted(vector_to_array(features))
