"""Scaling, one-hot encoding and named design-matrix columns."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

MISSING_CATEGORY = "nan"
FEATURES = "features"


class PopulationScaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Centre to mean 0 and divide by the population deviation, as ``num__`` columns."""

    columns = Param(Params._dummy(), "columns", "numeric columns", TypeConverters.toListString)
    complete = Param(Params._dummy(), "complete", "refuse missing values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns=None, complete=False):
        super().__init__()
        self._setDefault(complete=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        columns = self.getOrDefault(self.columns)
        row = dataset.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns],
        ).first()
        missing = [f"{c} ({row[f'n_{c}']} rows)" for c in columns if row[f"n_{c}"]]
        if missing and self.getOrDefault(self.complete):
            raise ValueError(f"missing values in {', '.join(missing)}")
        means = [float(row[f"m_{c}"] or 0.0) for c in columns]
        # a constant column is only centred
        scales = [float(row[f"s_{c}"] or 1.0) for c in columns]
        return PopulationScalerModel(columns=list(columns), means=means, scales=scales)


class PopulationScalerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "numeric columns", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "divisor per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = zip(*[self.getOrDefault(p) for p in (self.columns, self.means, self.scales)])
        return dataset.withColumns({f"num__{c}": (F.col(c) - m) / s for c, m, s in learned})


class FillMissingCategory(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Give missing categories a name of their own before indexing."""

    columns = Param(Params._dummy(), "columns", "category columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getOrDefault(self.columns)
        return dataset.withColumns(
            {f"filled__{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)) for c in columns}
        )


def encoding_stages(numeric: list[str] | None = None, categorical: list[str] | None = None) -> list:
    """Stages from cleaned columns to one ``features`` vector.

    Training on a missing number fails and names the column. Known categories become unit vectors; unseen ones take the index "keep"
    reserves, which ``dropLast`` turns into all zeros.
    """
    numeric = list(numeric or NUMERIC_FEATURES)
    categorical = list(categorical or CATEGORICAL_FEATURES)
    indexed = [f"index__{c}" for c in categorical]
    return [
        PopulationScaler(columns=numeric, complete=True),
        FillMissingCategory(columns=categorical),
        StringIndexer(
            inputCols=[f"filled__{c}" for c in categorical],
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=[f"cat__{c}" for c in categorical], dropLast=True),
        VectorAssembler(
            inputCols=[f"num__{c}" for c in numeric] + [f"cat__{c}" for c in categorical],
            outputCol=FEATURES,
        ),
    ]


def feature_names(df: DataFrame, column: str = FEATURES) -> list[str]:
    """Names of the design-matrix columns, read from the vector's metadata."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    named = sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])
    return [a["name"] for a in named]
