"""The training job: split, features, all classifiers, ranking, artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.leaderboard import rank_models, result_rows
from riskweave.operators.models import MODEL_NAMES, Sizes
from riskweave.operators.splits import stratified_folds, stratified_split
from riskweave.operators.validation import require_columns
from riskweave.plans.evaluate import evaluate_classifier, learning_curve_summary, model_curve, report_on, stack
from riskweave.plans.features import ml_pipeline
from riskweave.plans.ledger import Ledger, fingerprint
from riskweave.schema import KEY, TARGET
from riskweave.session import materialised, scratch_path
from riskweave.sources.artifacts import save_artifacts

#: Stands for a fresh folder in the shared one.
SHARED = "shared"


@dataclass
class TrainingResult:
    leaderboard: DataFrame
    best_name: str
    models: dict[str, Model]
    parts: DataFrame
    features: PipelineModel
    train: DataFrame
    test: DataFrame
    report: DataFrame
    curves: dict[str, DataFrame]

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def fit_features(train: DataFrame, as_of: str) -> PipelineModel:
    """Fit cleaning and encoding on the training rows."""
    require_columns(train)
    return ml_pipeline(as_of).fit(train)


def prepare(
    credit: DataFrame, as_of: str, share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Train and test design tables (key, label, features) and the fitted features."""
    rows = materialised(credit.where(F.col(TARGET).isNotNull()), "credit")
    train_raw, test_raw = stratified_split(rows, share=share, seed=seed)
    features = fit_features(train_raw, as_of)

    def design(rows: DataFrame) -> DataFrame:
        return features.transform(rows).select(KEY, F.col(TARGET).cast("int").alias(TARGET), "features")

    return design(train_raw), design(test_raw), features


def train_all(
    credit: DataFrame,
    as_of: str,
    folder: str | None = SHARED,
    names: Sequence[str] = tuple(MODEL_NAMES),
    primary: str = "cv_roc_auc_mean",
    secondary: str = "cv_recall_0_mean",
    share: float = 0.2,
    k: int = 5,
    seed: int = 42,
    sizes: Sizes = Sizes(),
    parallelism: int = 4,
    curve_fractions: Sequence[float] = (),
) -> TrainingResult:
    """Train, evaluate and rank the classifiers; save them in ``folder``, a fresh one in the shared folder if it is not named
    and none if it is None.

    ``parallelism`` models are fitted at a time, each in a scheduler pool of its own, so that under fair scheduling the
    short passes of one fill the gaps of another. With a folder every model's artifact and results are written as its fit
    ends (``ledger``); the same job started again reads them back and fits only what is missing. With ``curve_fractions``
    each classifier also gets its learning curve; a tree ensemble grows all sizes and folds of it together.
    """
    if folder == SHARED:
        folder = scratch_path(credit.sparkSession, "training")
    train, test, features = prepare(credit, as_of, share, seed)
    train = stratified_folds(train, k, TARGET, seed=seed).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.persist(StorageLevel.MEMORY_AND_DISK)
    spark = credit.sparkSession
    ledger = None
    if folder:
        job = fingerprint(train.unionByName(test.withColumn("fold", F.lit(0))), as_of=as_of, share=share, k=k, seed=seed, sizes=asdict(sizes))
        ledger = Ledger(spark, folder, job)

    def fitted(name: str) -> tuple[Model, DataFrame]:
        done = ledger.finished(name) if ledger else None
        if done is None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
            done = evaluate_classifier(name, train, test, k=k, seed=seed, sizes=sizes)
            if ledger:
                ledger.record(name, *done)
        return done

    with ThreadPool(parallelism) as pool:
        ended = dict(zip(names, pool.map(inheritable_thread_target(spark)(fitted), names, chunksize=1)))
    models = {name: model for name, (model, _) in ended.items()}
    curves = {
        name: learning_curve_summary(model_curve(name, train, curve_fractions, k, seed=seed, sizes=sizes)) for name in names if curve_fractions
    }

    parts = stack([measured for _, measured in ended.values()])  # one row per part: k + 2 a model
    leaderboard = rank_models(result_rows(parts), primary, secondary)
    best = leaderboard.first()["model"]
    if folder:
        save_artifacts(folder, models, best, features, saved=list(models))
    report = report_on(models[best], test)
    return TrainingResult(leaderboard, best, models, parts, features, train, test, report, curves)
