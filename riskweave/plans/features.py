"""Assembly of the feature stages."""

from __future__ import annotations

from pyspark.ml import Pipeline

from riskweave.operators.cleaning import (
    AsCategory,
    DropColumns,
    ExcludeCategories,
    KeepBelow,
    LoanDateFeatures,
    MissingValueFiller,
)
from riskweave.operators.encoding import encoding_stages
from riskweave.schema import SPARSE_COLUMNS, UNUSED_COLUMNS


def base_stages(as_of: str) -> list:
    """Cleaning stages in order; fill values are learned before any row is removed."""
    return [
        DropColumns(columns=SPARSE_COLUMNS),
        MissingValueFiller(),
        KeepBelow(),
        LoanDateFeatures(asOf=as_of),
        AsCategory(columns=["tipo_laboral", "tipo_credito"]),
        DropColumns(columns=UNUSED_COLUMNS),
        ExcludeCategories(),
    ]


def base_pipeline(as_of: str) -> Pipeline:
    return Pipeline(stages=base_stages(as_of))


def ml_pipeline(as_of: str) -> Pipeline:
    """Cleaning, then scaling and encoding into ``features``."""
    return Pipeline(stages=[*base_stages(as_of), *encoding_stages()])
