"""Probability, risk band and label expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower probability bound, band and recommendation, best band first.
RISK_BANDS = [
    (0.8, "Bajo", "APROBADO - Cliente de bajo riesgo"),
    (0.6, "Medio-Bajo", "APROBADO CON CONDICIONES - Monitoreo regular"),
    (0.4, "Medio", "REVISAR - Análisis adicional requerido"),
    (0.2, "Alto", "RECHAZADO - Alto riesgo de impago"),
    (None, "Muy Alto", "RECHAZADO - Riesgo extremo"),
]

# Display names of the two classes.
DECISION_NAMES = {1: "Aprobado", 0: "Rechazado"}
CLASS_NAMES = {1: "Pago", 0: "No Pago"}


def _banded(probability: Column, position: int) -> Column:
    chain = F
    for band in RISK_BANDS[:-1]:
        chain = chain.when(probability >= band[0], F.lit(band[position]))
    return chain.when(probability.isNotNull(), F.lit(RISK_BANDS[-1][position]))


def risk_level(probability: Column) -> Column:
    return _banded(probability, 1)


def recommendation(probability: Column) -> Column:
    return _banded(probability, 2)


def risk_score(probability: Column) -> Column:
    return probability * 100


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def margin_probability(raw_prediction: Column) -> Column:
    """Probability of class 1 from a raw prediction vector."""
    return sigmoid(vector_to_array(raw_prediction)[1])


def fallback_probability(prediction: Column) -> Column:
    """Stand-in for a model that gives neither probability nor margin."""
    return F.when(prediction == 1, F.lit(0.5)).otherwise(F.lit(0.3))


def class_one_probability(scored: DataFrame, probability="probability", raw="rawPrediction", prediction="prediction") -> Column:
    """Probability column of ``scored``: the model's own, else from the margin, else fixed."""
    if probability in scored.columns:
        return vector_to_array(F.col(probability))[1]
    if raw in scored.columns:
        return margin_probability(F.col(raw))
    return fallback_probability(F.col(prediction))


def is_high_risk(level: Column) -> Column:
    return level.contains("Alto")


def is_approved(text: Column) -> Column:
    return text.contains("APROBADO")


def colour_tier(level: Column) -> Column:
    """Traffic-light tier; the order of the tests makes Medio-Bajo a success."""
    return (
        F.when(level.contains("Bajo"), F.lit("success"))
        .when(level.contains("Medio"), F.lit("warning"))
        .otherwise(F.lit("error"))
    )


def decision_name(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(DECISION_NAMES[1])).otherwise(F.lit(DECISION_NAMES[0]))


def class_name(label: Column) -> Column:
    return F.when(label == 1, F.lit(CLASS_NAMES[1])).otherwise(F.lit(CLASS_NAMES[0]))


def stability(test_auc: Column, cv_auc: Column, test_recall: Column, cv_recall: Column) -> Column:
    """How far the test metrics stray from their cross-validated means."""
    auc_gap = F.abs(test_auc - cv_auc)
    recall_gap = F.abs(test_recall - cv_recall)
    return (
        F.when((auc_gap < 0.05) & (recall_gap < 0.1), F.lit("stable"))
        .when((auc_gap < 0.1) & (recall_gap < 0.15), F.lit("moderately stable"))
        .otherwise(F.lit("unstable"))
    )


def with_risk(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Append band, score and recommendation to rows that carry a probability."""
    p = F.col(probability)
    return df.withColumns(
        {
            "risk_level": risk_level(p),
            "risk_score": risk_score(p),
            "recommendation": recommendation(p),
        }
    )
