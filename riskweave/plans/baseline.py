"""The baseline job: the rule-based classifier on the cleaned table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.heuristic import HeuristicClassifier
from riskweave.operators.metrics import class_metrics, classification_report, confusion_matrix
from riskweave.operators.splits import stratified_folds, stratified_split
from riskweave.plans.evaluate import learning_curve_summary, rule_learning_curve
from riskweave.plans.features import base_pipeline
from riskweave.schema import KEY, TARGET
from riskweave.session import materialised

# Training sizes, repeats and folds of the baseline's evaluation.
FRACTIONS = [0.1, 0.325, 0.55, 0.775, 1.0]
REPEATS = 50
FOLDS = 10


def baseline_predictions(credit: DataFrame, as_of: str, **rules) -> DataFrame:
    """Cleaned rows with the rule-based prediction.

    Fill values are learned on all rows, before the split, as this job does.
    """
    cleaned = base_pipeline(as_of).fit(credit).transform(credit)
    return HeuristicClassifier(**rules).transform(cleaned)


def baseline_folds(train: DataFrame, k: int = FOLDS, seed: int = 42) -> DataFrame:
    """Metrics of the positive class per fold; the rules need no fitting, so one pass does."""
    folded = stratified_folds(train, k, TARGET, seed=seed)
    per_fold = class_metrics(folded, ["fold"], label=TARGET)
    return per_fold.select(
        "fold",
        "accuracy",
        F.col("precision_1").alias("precision"),
        F.col("recall_1").alias("recall"),
        F.col("f1_1").alias("f1"),
    )


@dataclass
class Baseline:
    """Predictions of all cleaned rows and their split; results are made on demand."""

    predicted: DataFrame
    train: DataFrame
    test: DataFrame
    seed: int

    def report(self) -> DataFrame:
        return classification_report(self.test, label=TARGET)

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.test, label=TARGET)

    def folds(self, k: int = FOLDS) -> DataFrame:
        return baseline_folds(self.train, k, self.seed)

    def learning_curve(self, repeats: int = REPEATS) -> DataFrame:
        return learning_curve_summary(rule_learning_curve(self.train, FRACTIONS, repeats))


def run_baseline(credit: DataFrame, as_of: str, share: float = 0.2, seed: int = 42) -> Baseline:
    """Clean, predict and split; three narrow columns are written for the reports."""
    predicted = baseline_predictions(credit, as_of).select(KEY, TARGET, "prediction")
    predicted = materialised(predicted, "baseline")
    train, test = stratified_split(predicted, share=share, seed=seed)
    return Baseline(predicted, train, test, seed)
