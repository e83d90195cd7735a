"""Proof that a fitted linear model is the best one: the gradient of what it minimises, from its coefficients and the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.newton import LinearMargin

INTERCEPT = "intercept"


def _margin(x: Column, coefficients: list[float], intercept: float) -> Column:
    return reduce(lambda a, b: a + b, [x[i] * F.lit(float(w)) for i, w in enumerate(coefficients)], F.lit(float(intercept)))


def _gradient(rows: DataFrame, x: Column, pull: Column, weight: Column, names: list[str], penalties: list[float], share: bool) -> DataFrame:
    """(feature, gradient): sums of ``pull`` times each feature, and of ``pull`` itself, over the total weight, plus the
    penalties (which are divided too unless they are a ``share``)."""
    total = F.sum(weight)
    sums = rows.agg(*[F.sum(pull * x[i]).alias(f"g{i}") for i in range(len(names))], F.sum(pull).alias(f"g{len(names)}"), total.alias("total"))
    cells = [
        F.struct(F.lit(n).alias("feature"), ((F.col(f"g{i}") + (0.0 if share else p)) / F.col("total") + (p if share else 0.0)).alias("gradient"))
        for i, (n, p) in enumerate(zip([*names, INTERCEPT], penalties))
    ]
    return sums.select(F.inline(F.array(*cells)))


def logistic_gradient(model: LogisticRegressionModel, rows: DataFrame, label: str, weight: Column, names: list[str], features: str = "features") -> DataFrame:
    """Per coefficient: the mean weighted gradient of the logistic loss plus the penalty; the constant is not penalised."""
    x = vector_to_array(features)
    coefficients = model.coefficients.toArray().tolist()
    p = 1 / (1 + F.exp(-_margin(x, coefficients, model.intercept)))
    penalties = [model.getRegParam() * w for w in coefficients] + [0.0]
    return _gradient(rows, x, weight * (p - F.col(label)), weight, names, penalties, share=True)


def hinge_gradient(model: LinearMargin, cost: float, rows: DataFrame, label: str, weight: Column, names: list[str], features: str = "features") -> DataFrame:
    """Per coefficient, the constant included: gradient of penalty and weighted squared hinge losses, per unit of weight."""
    x = vector_to_array(features)
    coefficients, intercept = model.getOrDefault("coefficients"), model.getOrDefault("intercept")
    sign = 2 * F.col(label) - 1
    slack = F.greatest(F.lit(0.0), 1 - sign * _margin(x, coefficients, intercept))
    return _gradient(rows, x, -2 * cost * weight * slack * sign, weight, names, [*coefficients, intercept], share=False)
