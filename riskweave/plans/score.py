"""Batch scoring: exclusions, features, probability, risk band."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.risk import class_one_probability, with_risk
from riskweave.operators.cleaning import ExcludeCategories, KeepBelow, MissingValueFillerModel, below_limit, not_excluded
from riskweave.operators.validation import require_columns
from riskweave.schema import NUMERIC_FEATURES

RECORD = "_record"
#: Reason given for a record that a stage on the column drops; other columns name themselves.
EXCLUSION_NAMES = {"edad_cliente": "age", "tipo_credito": "credit_type"}


def filled_columns(features: PipelineModel | None) -> list[str]:
    """Columns whose missing values the fitted pipeline replaces."""
    return [c for stage in _stages(features) if isinstance(stage, MissingValueFillerModel) for c in stage.fills()]


def _stages(features: PipelineModel | None) -> list:
    """All stages of a fitted pipeline; those of pipelines inside it stand in their place."""
    found = []
    for stage in features.stages if features else []:
        found += _stages(stage) if isinstance(stage, PipelineModel) else [stage]
    return found


def exclusion_reasons(features: PipelineModel | None = None) -> Column:
    """Why the fitted feature pipeline would drop a record, or could not use it.

    Limits and categories are those of its own stages; without a pipeline, those of the schema.
    """
    stages = _stages(features) if features else [KeepBelow(), ExcludeCategories()]
    needed = [c for c in NUMERIC_FEATURES if c not in {*filled_columns(features), "edad_cliente", "antiguedad_credito_meses"}]
    tests = []
    for stage in stages:
        if isinstance(stage, KeepBelow):
            column = stage.getOrDefault(stage.column)
            name = EXCLUSION_NAMES.get(column, column)
            tests.append((name, ~F.coalesce(below_limit(column, stage.getOrDefault(stage.limit)), F.lit(False))))
        elif isinstance(stage, ExcludeCategories):
            column = stage.getOrDefault(stage.column)
            name = EXCLUSION_NAMES.get(column, column)
            tests.append((name, ~not_excluded(column, stage.getOrDefault(stage.values))))
    if not any(isinstance(s, KeepBelow) and s.getOrDefault(s.column) == "edad_cliente" for s in stages):
        needed = ["edad_cliente", *needed]
    tests.append(("missing::fecha_prestamo", F.col("fecha_prestamo").isNull()))
    tests += [(f"missing::{c}", F.col(c).isNull()) for c in needed]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def with_exclusions(records: DataFrame, features: PipelineModel | None = None) -> DataFrame:
    require_columns(records)
    return records.withColumn("excluded_because", exclusion_reasons(features))


def split_excluded(records: DataFrame, features: PipelineModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that can be scored, and the others with ``excluded_because``."""
    marked = with_exclusions(records, features)
    usable = F.size("excluded_because") == 0
    return marked.where(usable).drop("excluded_because"), marked.where(~usable)


def score_records(
    records: DataFrame, features: PipelineModel, model: Model, own_probability_only: bool = False
) -> DataFrame:
    """The records with prediction, probability, risk band and recommendation.

    Input columns travel beside the features as one struct, so results stay on
    their own row without a join.
    """
    require_columns(records)
    carried = records.withColumn(RECORD, F.struct(*records.columns))
    scored = model.transform(features.transform(carried))
    if own_probability_only:
        own = vector_to_array(F.col("probability"))[1] if "probability" in scored.columns else F.lit(None).cast("double")
        probability = own
    else:
        probability = class_one_probability(scored)
    results = scored.select(
        f"{RECORD}.*", F.col("prediction").cast("int").alias("prediction"), probability.alias("probability")
    )
    return with_risk(results)


def score_batch(records: DataFrame, features: PipelineModel, model: Model) -> tuple[DataFrame, DataFrame]:
    """Scored records, and those excluded from scoring with the reason."""
    usable, excluded = split_excluded(records, features)
    return score_records(usable, features, model), excluded
