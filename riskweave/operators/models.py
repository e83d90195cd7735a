"""The classifier family and how a classifier is fitted and read out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.risk import fallback_probability
from riskweave.operators.bayes import GaussianBayes
from riskweave.operators.encoding import FEATURES
from riskweave.operators.exact_tree import ExactTree
from riskweave.operators.newton import SquaredHingeSvm
from riskweave.operators.tree_models import BoostedStumps, ForestClassifier, NewtonBoosting

# Trees are as deep as their rows can be parted.
UNBOUNDED = 1 << 30


@dataclass(frozen=True)
class Sizes:
    """Iteration counts and ensemble sizes; the defaults are the full-size models."""

    # fixed values
    logistic_iterations: int = 2000
    svc_iterations: int = 5000
    forest_trees: int = 300
    boosting_rounds: int = 600
    bagging_rounds: int = 100
    adaboost_rounds: int = 100
    depth: int = UNBOUNDED


MODEL_NAMES = [
    "logistic",
    "linear_svc",
    "naive_bayes",
    "decision_tree",
    "random_forest",
    "gradient_boosting",
    "bagging",
    "adaboost",
]

BALANCED = {"logistic", "linear_svc"}

# Models whose estimators weigh the classes themselves and grow those of all folds together; the single tree weighs them too.
TREE_ENSEMBLES = {"random_forest", "gradient_boosting", "bagging", "adaboost"}


def build_classifier(name: str, rows: int, label: str, seed: int = 42, sizes: Sizes = Sizes()) -> Estimator:
    """The named classifier; balanced weights sum to ``rows``, which sets the penalty."""
    columns = {"featuresCol": FEATURES, "labelCol": label}
    penalty = 1.0 / max(rows, 1)
    if name == "logistic":
        return LogisticRegression(
            **columns, weightCol="weight", maxIter=sizes.logistic_iterations, regParam=penalty, standardization=False
        )
    if name == "linear_svc":
        return SquaredHingeSvm(**columns, weightCol="weight", cost=1.0, maxIter=sizes.svc_iterations)
    if name == "naive_bayes":
        return GaussianBayes(**columns)
    if name == "decision_tree":
        return ExactTree(**columns, maxDepth=sizes.depth, balanced=True)
    if name == "random_forest":
        return ForestClassifier(**columns, trees=sizes.forest_trees, maxDepth=sizes.depth, balanced=True, seed=seed)
    if name == "gradient_boosting":
        return NewtonBoosting(**columns, rounds=sizes.boosting_rounds, seed=seed)
    if name == "bagging":
        return ForestClassifier(
            **columns, trees=sizes.bagging_rounds, nodeFeatures=-1, treeFeatures=0.8, drawShare=0.8, maxDepth=sizes.depth, seed=seed
        )
    if name == "adaboost":
        return BoostedStumps(**columns, rounds=sizes.adaboost_rounds, seed=seed)
    raise ValueError(f"unknown classifier {name!r}; known: {', '.join(MODEL_NAMES)}")


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def fit_classifier(
    name: str, train: DataFrame, label: str, seed: int = 42, sizes: Sizes = Sizes()
) -> Model:
    """Fit one classifier with the class weighting it asks for."""
    if name in TREE_ENSEMBLES:
        return build_classifier(name, 0, label, seed, sizes).fit(train)
    counts = class_counts(train, label)
    total = sum(counts.values())
    if name in BALANCED:
        per_class = {c: total / (len(counts) * n) for c, n in counts.items()}
        chain = F
        for value, weight in per_class.items():
            chain = chain.when(F.col(label) == value, F.lit(weight))
        train = train.withColumn("weight", chain)
    return build_classifier(name, total, label, seed, sizes).fit(train)


def fit_classifiers(
    names: Sequence[str], train: DataFrame, label: str, seed: int = 42, sizes: Sizes = Sizes(), parallelism: int = 4
) -> dict[str, Model]:
    """Several classifiers of the same rows, some at a time, each in a scheduler pool of its own."""
    spark = train.sparkSession

    def fit(name: str) -> Model:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        return fit_classifier(name, train, label, seed, sizes)

    with ThreadPool(parallelism) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(spark)(fit), names, chunksize=1)))


def fit_parts(
    name: str, train: DataFrame, label: str, folds: Sequence[int], seed: int = 42, sizes: Sizes = Sizes(), parallelism: int = 1, whole: bool = True
) -> dict[int, Model]:
    """The models of a cross-validation over the column ``fold``, by the fold left out, and with ``whole`` the one of all rows as 0.

    Tree ensembles grow all of them in the same passes; the others are fitted ``parallelism`` at a time.
    """
    if name in TREE_ENSEMBLES:
        return build_classifier(name, 0, label, seed, sizes).fit_folds(train, "fold", max(folds), whole)

    def fit(left_out: int) -> Model:
        return fit_classifier(name, train.where(F.col("fold") != left_out) if left_out else train, label, seed, sizes)

    parts = [0, *folds] if whole else list(folds)
    with ThreadPool(parallelism) as pool:
        return dict(zip(parts, pool.map(inheritable_thread_target(train.sparkSession)(fit), parts)))


def ranking_score(scored: DataFrame) -> Column:
    """What the curves rank by: the probability, else the margin, else a constant pair."""
    for column in ("probability", "rawPrediction"):
        if column in scored.columns:
            return vector_to_array(F.col(column))[1]
    return fallback_probability(F.col("prediction"))


def scored_rows(model: Model, df: DataFrame, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Label, prediction and ranking score of every row: the metrics' input."""
    scored = model.transform(df)
    return scored.select(
        *keep,
        F.col(label).cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        ranking_score(scored).alias("score"),
    )
