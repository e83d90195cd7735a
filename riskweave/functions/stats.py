"""Student-t tail probability, the one statistic Spark has no expression for."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The functions travel inside the UDF, so workers need not have this package.
register_pickle_by_value(sys.modules[__name__])


#: Nodes and weights of the quadrature on one panel, and the panels of the tail.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(16)
PANELS = 256


def gamma_ratio(a: float) -> float:
    """Gamma(a + 1/2) / Gamma(a): steps up to a large argument, where the series of the logarithm's difference holds."""
    factor = 1.0
    while a < 32:
        factor *= a / (a + 0.5)
        a += 1
    series = -1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)
    return factor * math.sqrt(a) * math.exp(series)


def two_sided_p(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom.

    With u = sqrt(dof) tan(phi) the density is a power of the cosine; its tail is summed by quadrature up to a right
    angle, or to where it has long vanished.
    """
    root = math.sqrt(dof)
    start = math.atan(abs(t) / root)
    end = min(math.pi / 2, start + 40 / root)
    edges = np.linspace(start, end, PANELS + 1)
    half = (edges[1:] - edges[:-1]) / 2
    phi = (edges[:-1] + half)[:, None] + half[:, None] * NODES
    # log cos through the sine, so that small angles keep their digits
    power = np.exp((dof - 1) / 2 * np.log1p(-np.minimum(np.sin(phi) ** 2, 1 - 1e-300)))
    area = float((power * WEIGHTS * half[:, None]).sum())
    return min(1.0, 2 * gamma_ratio(dof / 2) / math.sqrt(math.pi) * area)


def student_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value; meant for aggregated rows, one per tested feature."""

    @F.pandas_udf(T.DoubleType())
    def p_value(ts: pd.Series, dofs: pd.Series) -> pd.Series:
        pairs = [None if pd.isna(a) or pd.isna(b) else two_sided_p(a, b) for a, b in zip(ts, dofs)]
        return pd.Series(pairs, dtype="float64")

    return p_value(t, dof)


def pooled_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Two-sample t statistic with pooled variance; null when that variance is 0."""
    pooled = F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, n_a + n_b - 2)
    scale = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    return F.try_divide(mean_a - mean_b, scale)
