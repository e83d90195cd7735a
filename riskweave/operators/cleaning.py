"""Feature-preparation stages; each is a persistable Spark ML stage.

Stages that learn keep what they learned in params, so ``PipelineModel.save``
and ``load`` need nothing beyond the default params writer.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import credit_age_months, loan_month
from riskweave.operators.order_statistics import medians_and_means
from riskweave.schema import AGE_LIMIT, EXCLUDED_CREDIT_TYPES, MEAN_COLUMNS, MEDIAN_COLUMNS


def below_limit(column: str, limit: float) -> Column:
    """Rows below the limit; a missing value is neither and so does not pass a filter."""
    return F.col(column) < limit


def not_excluded(column: str, values: list[str]) -> Column:
    """Rows outside the excluded values; a missing value passes.

    Written without ``coalesce`` so that the scan can evaluate it.
    """
    return F.col(column).isNull() | ~F.col(column).isin(values)


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the stateless stages."""


class DropColumns(_Stage):
    """Drop the listed columns; absent ones are ignored."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault(self.columns))


class KeepBelow(_Stage):
    """Keep rows whose column is below a limit."""

    column = Param(Params._dummy(), "column", "tested column", TypeConverters.toString)
    limit = Param(Params._dummy(), "limit", "exclusive upper limit", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, column="edad_cliente", limit=AGE_LIMIT):
        super().__init__()
        self._setDefault(column="edad_cliente", limit=float(AGE_LIMIT))
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.where(below_limit(self.getOrDefault(self.column), self.getOrDefault(self.limit)))


class LoanDateFeatures(_Stage):
    """Loan month and credit age at a stated date."""

    dateColumn = Param(Params._dummy(), "dateColumn", "loan date column", TypeConverters.toString)
    asOf = Param(Params._dummy(), "asOf", "date the age is measured on", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, dateColumn="fecha_prestamo", asOf=None):
        super().__init__()
        self._setDefault(dateColumn="fecha_prestamo")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        date = F.col(self.getOrDefault(self.dateColumn))
        as_of = F.to_date(F.lit(self.getOrDefault(self.asOf)))
        return dataset.withColumns(
            {
                "mes_prestamo": loan_month(date),
                "antiguedad_credito_meses": credit_age_months(date, as_of),
            }
        )


class AsCategory(_Stage):
    """Turn the listed columns into text categories where present."""

    columns = Param(Params._dummy(), "columns", "category columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        present = [c for c in self.getOrDefault(self.columns) if c in dataset.columns]
        return dataset.withColumns({c: F.col(c).cast("string") for c in present})


class ExcludeCategories(_Stage):
    """Remove rows of the listed categories, keeping missing ones."""

    column = Param(Params._dummy(), "column", "category column", TypeConverters.toString)
    values = Param(Params._dummy(), "values", "categories to remove", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, column="tipo_credito", values=EXCLUDED_CREDIT_TYPES):
        super().__init__()
        self._setDefault(column="tipo_credito", values=list(EXCLUDED_CREDIT_TYPES))
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.where(not_excluded(self.getOrDefault(self.column), self.getOrDefault(self.values)))


class _FillParams(Params):
    medianColumns = Param(Params._dummy(), "medianColumns", "columns filled with the exact median", TypeConverters.toListString)
    meanColumns = Param(Params._dummy(), "meanColumns", "columns filled with the mean", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(medianColumns=list(MEDIAN_COLUMNS), meanColumns=list(MEAN_COLUMNS))


class MissingValueFiller(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learn exact medians and means; the model fills missing values with them."""

    @keyword_only
    def __init__(self, *, medianColumns=MEDIAN_COLUMNS, meanColumns=MEAN_COLUMNS):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MissingValueFillerModel:
        medians = self.getOrDefault(self.medianColumns)
        means = self.getOrDefault(self.meanColumns)
        fills = medians_and_means(dataset, medians, means)
        known = {c: v for c, v in fills.items() if v is not None}
        return MissingValueFillerModel(columns=list(known), values=[float(v) for v in known.values()])


class MissingValueFillerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "filled columns", TypeConverters.toListString)
    values = Param(Params._dummy(), "values", "fill value per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def fills(self) -> dict[str, float]:
        return dict(zip(self.getOrDefault(self.columns), self.getOrDefault(self.values)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills().items()})


def attach_labels(rows: DataFrame, labels: DataFrame, key: str = "loan_id") -> DataFrame:
    """Labels onto rows by key; rows without one get null."""
    return rows.join(labels, key, "left")


def labels_of(labels: DataFrame, rows: DataFrame, key: str = "loan_id") -> DataFrame:
    """The labels whose rows survived filtering."""
    return labels.join(rows.select(key), key, "left_semi")
