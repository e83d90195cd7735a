"""Linear support vector machine with squared hinge loss, solved by Newton steps over distributed sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialised

#: Step lengths whose objectives one pass compares.
STEPS = 0.5 ** np.arange(12)


class _Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight per row; empty: 1", TypeConverters.toString)
    cost = Param(Params._dummy(), "cost", "weight of the losses against the penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "Newton steps", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "largest gradient component per unit of weight", TypeConverters.toFloat)


def hinge_sums(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the weighted squared hinge losses of some rows, in one flat array."""
    slack = np.maximum(1 - sign * (x @ w), 0)
    active = slack > 0
    rows, pull = x[active], (weight * slack)[active]
    return np.concatenate([[float((weight * slack * slack).sum())], -2 * rows.T @ (pull * sign[active]),
                           (2 * (rows * weight[active, None]).T @ rows).ravel()])


class SquaredHingeSvm(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Minimises |w|**2 / 2 + cost * sum of weight * max(0, 1 - y w.x)**2, the constant being one more feature of value 1.

    Every step is one pass for the gradient and the Hessian over the rows inside the margin and one that compares step
    lengths; tasks send sums whose size is the square of the number of features, whatever the rows. The end is a
    gradient below ``tol`` per unit of weight in every component, which ``gradient_per_weight`` of the model records.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="", cost=1.0, maxIter=100, tol=1e-8):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", cost=1.0, maxIter=100, tol=1e-8)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearMargin:
        get = self.getOrDefault
        weight = F.col(get(self.weightCol)).cast("double") if get(self.weightCol) else F.lit(1.0)
        rows = dataset.where(F.col(get(self.labelCol)).isNotNull()).select(
            vector_to_array(get(self.featuresCol)).alias("x"), (2 * F.col(get(self.labelCol)).cast("double") - 1).alias("sign"), weight.alias("weight"))
        rows = materialised(rows, "margin-rows")
        first = rows.agg(F.sum("weight").alias("total"), F.max(F.size("x")).alias("n")).first()
        if not first["total"]:
            raise ValueError("no rows with a weight")
        width, cost, w = first["n"] + 1, get(self.cost), np.zeros(first["n"] + 1)
        size = 1 + width + width * width
        worst = np.inf
        for _ in range(get(self.maxIter)):
            here = w
            sums = _summed(rows, lambda x, s, u: hinge_sums(x, s, u, here), size)
            gradient = w + cost * sums[1 : 1 + width]
            worst = float(np.abs(gradient).max() / first["total"])
            if worst <= get(self.tol):
                break
            step = np.linalg.solve(np.eye(width) + cost * sums[1 + width :].reshape(width, width), gradient)
            tried = w[:, None] - step[:, None] * STEPS
            losses = _summed(rows, lambda x, s, u: u @ np.maximum(1 - s[:, None] * (x @ tried), 0) ** 2, len(STEPS))
            best = int((0.5 * (tried * tried).sum(axis=0) + cost * losses).argmin())
            w = tried[:, best]
        return LinearMargin(featuresCol=get(self.featuresCol), coefficients=w[:-1].tolist(), intercept=float(w[-1]), gradient=worst)


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(x, sign, weight)``: one array a task, added up by Spark."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in parts:
            if part.num_rows:
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                sign, weight = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sign", "weight"))
                total += of(np.column_stack([x, np.ones(len(x))]), sign, weight)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["place", "value"])

    added = rows.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = np.zeros(size)
    table = added.toArrow()
    found[table.column("place").to_numpy()] = table.column("value").to_numpy()
    return found


class LinearMargin(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Appends rawPrediction (minus and plus the margin) and prediction; there is no probability."""

    coefficients = Param(Params._dummy(), "coefficients", "weight per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant", TypeConverters.toFloat)
    gradient = Param(Params._dummy(), "gradient", "largest gradient component per unit of weight at the end", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", coefficients=None, intercept=None, gradient=None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.coefficients))

    @property
    def gradient_per_weight(self) -> float:
        return self.getOrDefault(self.gradient)

    def margin(self, x: Column) -> Column:
        terms = [x[i] * w for i, w in enumerate(self.getOrDefault(self.coefficients))]
        return reduce(lambda a, b: a + b, terms, F.lit(self.getOrDefault(self.intercept)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("_margin", self.margin(vector_to_array(self.getOrDefault(self.featuresCol))))
        return scored.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
            "prediction": (F.col("_margin") > 0).cast("double"),
        }).drop("_margin")
