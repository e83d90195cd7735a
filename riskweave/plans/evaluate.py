"""Cross-validation, learning curves and evaluation of labelled tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.metrics import class_metrics, classification_report, confusion_matrix, detailed_metrics, ratio
from riskweave.operators.models import TREE_ENSEMBLES, Sizes, build_classifier, fit_classifier, fit_parts, scored_rows
from riskweave.operators.order_statistics import at_or_below, group_lookup, hash_key, key_cuts
from riskweave.operators.row_blocks import MOST_MODELS
from riskweave.operators.splits import repeated, sample_ranks, stratified_folds, test_size
from riskweave.operators.validation import with_violations
from riskweave.plans.score import score_records, with_exclusions
from riskweave.schema import KEY, TARGET
from riskweave.session import materialised

Fit = Callable[[DataFrame], Model]
#: Fits many models by a mask of rows, and gives the array of what they predict of a row.
Together = tuple[Callable[[DataFrame, Column, int], dict[int, Model]], Callable[[Sequence[Model]], Column]]

# Metrics of the two cross-validation reports.
MODEL_REPORT = ["roc_auc", "average_precision", "recall", "precision", "f1"]
BASELINE_REPORT = ["accuracy", "precision", "recall", "f1"]

# Training sizes of the models' learning curves.
MODEL_FRACTIONS = [i / 10 for i in range(1, 11)]

# What an evaluation records for a row that cannot be scored.
UNSCORED = {"prediction": 0, "probability": 0.5, "risk_level": "Error", "recommendation": "Error"}


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def fold_scores(
    fit: Fit, folded: DataFrame, label: str = TARGET, parallelism: int = 1
) -> DataFrame:
    """Held-out label, prediction and score of every row, with its ``fold``."""
    folds = sorted(r["fold"] for r in folded.select("fold").distinct().collect())

    def held_out(fold: int) -> DataFrame:
        model = fit(folded.where(F.col("fold") != fold))
        return scored_rows(model, folded.where(F.col("fold") == fold), label, keep=("fold",))

    with ThreadPool(parallelism) as pool:
        return stack(pool.map(held_out, folds))


def detailed_cross_validation(
    fit: Fit, train: DataFrame, k: int = 5, label: str = TARGET, seed: int = 42, parallelism: int = 1
) -> DataFrame:
    """Accuracy, per-class metrics and curve areas per fold; every fold is fitted once."""
    folded = stratified_folds(train, k, label, seed=seed)
    return detailed_metrics(fold_scores(fit, folded, label, parallelism), ["fold"])


def cross_validation_report(detailed: DataFrame, metrics: Sequence[str] = MODEL_REPORT) -> DataFrame:
    """The metric x fold table; a metric that could not be computed is null."""
    named = {
        "accuracy": "accuracy",
        "roc_auc": "roc_auc",
        "average_precision": "pr_auc",
        "recall": "recall_1",
        "precision": "precision_1",
        "f1": "f1_1",
    }
    return detailed.select("fold", *[F.col(named[m]).alias(m) for m in metrics])


def evaluate_classifier(
    name: str,
    train: DataFrame,
    test: DataFrame,
    label: str = TARGET,
    k: int = 5,
    seed: int = 42,
    sizes: Sizes = Sizes(),
    parallelism: int = 1,
) -> tuple[Model, DataFrame]:
    """Final model, and metrics per part: every fold, the train and the test table.

    ``train`` must carry ``fold``; all parts are scored in one pass.
    """

    models = fit_parts(name, train, label, range(1, k + 1), seed, sizes, parallelism)
    held_out = [scored_rows(models[i], train.where(F.col("fold") == i), label).withColumn("part", F.lit(f"fold_{i}")) for i in range(1, k + 1)]
    model = models[0]
    parts = stack(
        [
            *held_out,
            scored_rows(model, train, label).withColumn("part", F.lit("train")),
            scored_rows(model, test, label).withColumn("part", F.lit("test")),
        ]
    )
    # scored once, then read by every metric; what remains is one row per part
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        measured = detailed_metrics(parts, ["part"]).withColumn("model", F.lit(name))
        return model, train.sparkSession.createDataFrame(measured.collect(), measured.schema)
    finally:
        parts.unpersist()


def cross_validated(
    names: Sequence[str], folded: DataFrame, label: str = TARGET, k: int = 5, seed: int = 42, sizes: Sizes = Sizes(), parallelism: int = 4
) -> DataFrame:
    """Class metrics and curve areas per model and fold (column ``fold``); the models of a tree ensemble grow together."""
    spark = folded.sparkSession

    def held_out(name: str) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        models = fit_parts(name, folded, label, range(1, k + 1), seed, sizes, whole=False)  # no part is scored by the model of all rows
        rows = [scored_rows(models[i], folded.where(F.col("fold") == i), label, keep=("fold",)) for i in range(1, k + 1)]
        measured = detailed_metrics(materialised(stack(rows), "held-out"), ["fold"]).withColumn("model", F.lit(name))
        return spark.createDataFrame(measured.collect(), measured.schema)  # one row per fold

    with ThreadPool(parallelism) as pool:
        return stack(pool.map(inheritable_thread_target(spark)(held_out), names, chunksize=1))


def report_on(model: Model, test: DataFrame, label: str = TARGET) -> DataFrame:
    """Classification report of a fitted model on the test table."""
    return classification_report(scored_rows(model, test, label))


def confusion_on(model: Model, test: DataFrame, label: str = TARGET) -> DataFrame:
    """Confusion matrix of a fitted model on the test table."""
    return confusion_matrix(scored_rows(model, test, label))


def learning_curve(
    fit: Fit,
    train: DataFrame,
    fractions: Sequence[float] = tuple(MODEL_FRACTIONS),
    k: int = 5,
    label: str = TARGET,
    seed: int = 42,
    metric: str = "recall_1",
    together: Together | None = None,
) -> DataFrame:
    """Train and validation score, fit and score seconds per training size and fold.

    Training rows of a fold are nested hash samples, so each size contains the
    smaller ones. ``together`` fits the models of all sizes and folds in one pass,
    each row marked with those it belongs to, and predicts by all of them in
    another; their seconds are shared out evenly.
    """
    spark = train.sparkSession
    folded, shuffled, cuts = curve_cuts(train, fractions, k, label, seed)
    if together is not None and k * len(fractions) <= MOST_MODELS:
        return _curve_together(together, folded, shuffled, cuts, fractions, label, metric)
    rows = []
    for fold, fold_cuts in sorted(cuts.items()):
        validation = folded.where(F.col("fold") == fold)
        candidates = folded.where(F.col("fold") != fold)
        for fraction, cut in zip(fractions, fold_cuts):
            sample = candidates.where(at_or_below(shuffled, cut))
            started = time.perf_counter()
            model = fit(sample)
            fitted = time.perf_counter()
            both = stack(
                [
                    scored_rows(model, sample, label).withColumn("part", F.lit("train")),
                    scored_rows(model, validation, label).withColumn("part", F.lit("validation")),
                ]
            )
            scores = {r["part"]: r[metric] for r in class_metrics(both, ["part"]).collect()}
            scored = time.perf_counter()
            rows.append((float(fraction), fold, scores["train"], scores["validation"], fitted - started, scored - fitted))
    return spark.createDataFrame(
        rows,
        "fraction double, fold int, train_score double, validation_score double, "
        "fit_seconds double, score_seconds double",
    )


def curve_mask(points: Sequence[tuple[int, int]], shuffled: Column, cuts: dict) -> Column:
    """Bit m: the row is among the training rows of point m, a held-out fold and a size."""
    inside = [(F.col("fold") != fold) & at_or_below(shuffled, cuts[fold][i]) for fold, i in points]
    return reduce(lambda a, b: a + b, [F.when(there, F.lit(1 << m)).otherwise(F.lit(0)) for m, there in enumerate(inside)])


def _curve_together(
    together: Together, folded: DataFrame, shuffled: Column, cuts: dict, fractions: Sequence[float], label: str, metric: str
) -> DataFrame:
    fit, predicted = together
    points = [(f, i) for f in sorted(cuts) for i in range(len(fractions))]
    marked = folded.withColumn("_key", shuffled).withColumn("_mask", curve_mask(points, F.col("_key"), cuts))
    marked = materialised(marked.drop("_key"), "curve-rows")
    started = time.perf_counter()
    models = fit(marked, F.col("_mask"), len(points))
    fitted = time.perf_counter()
    predictions = F.posexplode(predicted([models[m] for m in range(len(points))])).alias("point", "prediction")
    scored = marked.select(F.col(label).cast("int").alias("label"), "fold", "_mask", predictions)
    held_out = F.col("fold") == F.lit([f for f, _ in points])[F.col("point")]
    part = F.when(held_out, F.lit("validation")).when(F.expr("shiftright(_mask, point) & 1") == 1, F.lit("train"))
    rows = scored.withColumn("part", part).where("part is not null").select("point", "part", "label", "prediction")
    scores: dict[int, dict[str, float]] = {}
    for r in class_metrics(rows, ["point", "part"]).collect():
        scores.setdefault(r["point"], {})[r["part"]] = r[metric]
    spent, scoring = (fitted - started) / len(points), (time.perf_counter() - fitted) / len(points)
    found = [(float(fractions[i]), fold, scores[m]["train"], scores[m]["validation"], spent, scoring) for m, (fold, i) in enumerate(points)]
    return folded.sparkSession.createDataFrame(
        found, "fraction double, fold int, train_score double, validation_score double, fit_seconds double, score_seconds double"
    )


def curve_cuts(train: DataFrame, fractions: Sequence[float], k: int, label: str, seed: int) -> tuple[DataFrame, Column, dict]:
    """``train`` with its folds, the row's sampling key, and per held-out fold the key that ends each training size.

    The samples of a fold are nested: each is a range of ranks of one written table, so each size contains the smaller ones.
    """
    folded = materialised(stratified_folds(train.drop("fold"), k, label, seed=seed), "folded")
    shuffled = hash_key(F.col(KEY), "sample", seed)
    others = F.filter(F.array(*[F.lit(i) for i in range(1, k + 1)]), lambda i: i != F.col("fold"))
    keyed = folded.select(F.explode(others).alias("held_out"), shuffled.alias("_key"))
    return folded, shuffled, key_cuts(keyed, "held_out", "_key", lambda n: sample_ranks(n, list(fractions)), k)


def model_curve(
    name: str,
    train: DataFrame,
    fractions: Sequence[float] = tuple(MODEL_FRACTIONS),
    k: int = 5,
    label: str = TARGET,
    seed: int = 42,
    sizes: Sizes = Sizes(),
    metric: str = "recall_1",
    parallelism: int = 4,
) -> DataFrame:
    """Train and validation score of one classifier per training size and fold, and seconds to fit and to score.

    A tree ensemble grows the models of all sizes and folds in the same passes, each row marked with those it belongs to;
    of the others ``parallelism`` are fitted at a time. Seconds of models that grow together are shared out evenly. All
    models are scored on the table of folds, and the counts of all of them come from one aggregation.
    """
    folded, shuffled, cuts = curve_cuts(train, fractions, k, label, seed)
    points = [(f, i) for f in sorted(cuts) for i in range(len(fractions))]

    def inside(fold: int, i: int) -> Column:
        return (F.col("fold") != fold) & at_or_below(shuffled, cuts[fold][i])

    started = time.perf_counter()
    if name in TREE_ENSEMBLES:
        mask = curve_mask(points, shuffled, cuts)
        models = build_classifier(name, 0, label, seed, sizes).fit_members(folded, mask, len(points))
        spent = dict.fromkeys(range(len(points)), (time.perf_counter() - started) / len(points))
    else:
        spent = {}

        def fit(m: int) -> Model:
            begun = time.perf_counter()
            model = fit_classifier(name, folded.where(inside(*points[m])), label, seed, sizes)
            spent[m] = time.perf_counter() - begun
            return model

        with ThreadPool(parallelism) as pool:
            models = dict(enumerate(pool.map(inheritable_thread_target(train.sparkSession)(fit), range(len(points)), chunksize=1)))
    started = time.perf_counter()
    counted = []
    for m, (fold, i) in enumerate(points):
        part = F.when(F.col("fold") == fold, F.lit("validation")).when(inside(fold, i), F.lit("train"))
        rows = folded.withColumn("part", part).where("part is not null")
        counted.append(scored_rows(models[m], rows, label, keep=("part",)).withColumn("point", F.lit(m)))
    scores: dict[int, dict[str, float]] = {}
    for a in range(0, len(counted), k):  # a union of all would make one plan of them
        for r in class_metrics(stack(counted[a : a + k]), ["point", "part"]).collect():
            scores.setdefault(r["point"], {})[r["part"]] = r[metric]
    scored = (time.perf_counter() - started) / len(points)
    rows = [(float(fractions[i]), fold, scores[m]["train"], scores[m]["validation"], spent[m], scored) for m, (fold, i) in enumerate(points)]
    return train.sparkSession.createDataFrame(
        rows, "fraction double, fold int, train_score double, validation_score double, fit_seconds double, score_seconds double"
    )


def learning_curve_summary(curve: DataFrame) -> DataFrame:
    """Mean and population deviation per size, and the train - validation gap."""
    measures = [c for c in ("train_score", "validation_score", "fit_seconds", "score_seconds") if c in curve.columns]
    rolled = curve.groupBy("fraction").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in measures],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in measures],
    )
    return rolled.withColumn("gap", F.col("train_score_mean") - F.col("validation_score_mean"))


def rule_learning_curve(
    predicted: DataFrame,
    fractions: Sequence[float],
    repeats: int = 50,
    share: float = 0.2,
    seed: int = 123,
    label: str = TARGET,
) -> DataFrame:
    """Recall by training size for a classifier that learns nothing from the rows.

    Its prediction of a row is the same in every repeat, so all repeats and
    sizes are counted in one aggregation over the split copies instead of one
    fit each. In a repeat's key order the test rows come first, then the
    training rows, so a training size is a run of ranks.
    """

    def ranks(n: int) -> list[int]:
        held_out = test_size(n, share)
        return [held_out, *[held_out + size for size in sample_ranks(n - held_out, list(fractions))]]

    predicted = materialised(predicted.select(KEY, label, "prediction"), "predicted")
    cuts = key_cuts(repeated(predicted.select(KEY), repeats, seed=seed), "repeat", "_key", ranks, repeats)
    copies = repeated(predicted, repeats, seed=seed).withColumn(
        "_cuts", group_lookup("repeat", cuts)
    )
    copies = copies.select(
        "repeat",
        (F.col(label) == 1).alias("positive"),
        ((F.col(label) == 1) & (F.col("prediction") == 1)).alias("hit"),
        at_or_below(F.col("_key"), F.col("_cuts")[0]).alias("is_test"),
        *[at_or_below(F.col("_key"), F.col("_cuts")[i + 1]).alias(f"within_{i}") for i in range(len(fractions))],
    )
    counts = copies.groupBy("repeat").agg(
        F.count(F.when(F.col("is_test") & F.col("positive"), 1)).alias("test_pos"),
        F.count(F.when(F.col("is_test") & F.col("hit"), 1)).alias("test_hit"),
        *[
            F.count(F.when(~F.col("is_test") & F.col(f"within_{i}") & test, 1)).alias(f"{name}_{i}")
            for i in range(len(fractions))
            for name, test in (("pos", F.col("positive")), ("hit", F.col("hit")), ("n", F.lit(True)))
        ],
    )
    sizes = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("fraction"),
                F.col(f"n_{i}").alias("train_rows"),
                ratio(F.col(f"hit_{i}"), F.col(f"pos_{i}")).alias("train_score"),
                ratio(F.col("test_hit"), F.col("test_pos")).alias("validation_score"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    return counts.select("repeat", F.inline(sizes))


def with_fallback(rejected: DataFrame) -> DataFrame:
    """Rows that cannot be scored, with the values an evaluation records for them."""
    return rejected.withColumns({name: F.lit(value) for name, value in UNSCORED.items()})


def evaluate_labelled(
    records: DataFrame, features: PipelineModel, model: Model, label: str = TARGET
) -> DataFrame:
    """Every labelled record with its result; rejected and excluded ones fall back."""
    wanted = [*records.columns, *UNSCORED]
    checked = materialised(with_exclusions(with_violations(records), features), "checked")
    usable = (F.size("violations") == 0) & (F.size("excluded_because") == 0)
    scored = score_records(
        checked.where(usable).drop("violations", "excluded_because"), features, model
    )
    fallback = with_fallback(checked.where(~usable))
    return scored.select(*wanted).unionByName(fallback.select(*wanted))


def evaluate_stored(
    records: DataFrame, features: PipelineModel, model: Model
) -> DataFrame:
    """Offline scoring with stored artifacts; probability is null if the model has none."""
    scored = score_records(records, features, model, own_probability_only=True)
    return scored.drop("risk_level", "risk_score", "recommendation")
