"""Classifiers, ensembles, evaluation jobs, artifacts and scoring."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskweave import schema as S
from riskweave.operators import cleaning, metrics
from riskweave.operators.bayes import GaussianBayes
from riskweave.operators.exact_tree import ExactTree
from riskweave.operators.models import MODEL_NAMES, Sizes, build_classifier, fit_classifier, scored_rows
from riskweave.operators.heuristic import HeuristicClassifier
from riskweave.operators.newton import SquaredHingeSvm
from riskweave.plans import evaluate, score, train
from riskweave.plans.features import base_pipeline
from riskweave.session import scratch_path
from riskweave.sources import artifacts
from riskweave.sources.derived import CREDIT_AS_OF, credit_table

SMALL = Sizes(
    logistic_iterations=50, svc_iterations=20, forest_trees=5, boosting_rounds=3, bagging_rounds=3,
    adaboost_rounds=4, depth=5,
)


@pytest.fixture(scope="module")
def separable(spark):
    rows = spark.range(400).select(
        F.col("id").alias(S.KEY),
        (F.hash("id") % 100 / 100).alias("a"),
        (F.hash("id", F.lit(9)) % 100 / 100).alias("b"),
    )
    rows = rows.withColumn("y", (F.col("a") + F.col("b") * 0.3 > 0.2).cast("int"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).repartition(2, S.KEY).cache()


@pytest.mark.parametrize("name", MODEL_NAMES)
def test_classifier_beats_the_majority_and_repeats(separable, name):
    model = fit_classifier(name, separable, "y", sizes=SMALL)
    scored = scored_rows(model, separable, "y", keep=(S.KEY,))
    majority = separable.agg(F.greatest(F.avg("y"), 1 - F.avg("y"))).first()[0]
    assert metrics.overall_metrics(scored).first()["accuracy"] > majority
    assert metrics.curve_areas(scored).first()["roc_auc"] > 0.85
    again = scored_rows(fit_classifier(name, separable, "y", sizes=SMALL), separable, "y", keep=(S.KEY,))
    assert {tuple(r) for r in scored.collect()} == {tuple(r) for r in again.collect()}


@pytest.mark.parametrize("name", ["bagging", "adaboost", "linear_svc", "naive_bayes", "decision_tree", "gradient_boosting"])
def test_artifact_round_trip(spark, separable, name):
    model = artifacts.as_pipeline(fit_classifier(name, separable, "y", sizes=SMALL))
    path = scratch_path(spark, "model")
    model.write().save(path)
    loaded = PipelineModel.load(path)
    one = scored_rows(model, separable, "y", keep=(S.KEY,)).orderBy(S.KEY).collect()
    assert one == scored_rows(loaded, separable, "y", keep=(S.KEY,)).orderBy(S.KEY).collect()


def test_full_sizes_are_the_defaults():
    sizes = Sizes()
    assert (sizes.forest_trees, sizes.boosting_rounds, sizes.bagging_rounds, sizes.adaboost_rounds) == (300, 600, 100, 100)


def test_model_parameters():
    def get(name, *params):
        model = build_classifier(name, 50, "y")
        return tuple(model.getOrDefault(p) for p in params)

    assert get("gradient_boosting", "rounds", "stepSize", "maxDepth", "rowShare", "featureShare") == (600, 0.05, 6, 0.9, 0.9)
    assert get("random_forest", "trees", "nodeFeatures", "treeFeatures", "drawShare", "balanced") == (300, 0, 1.0, 1.0, True)
    assert get("bagging", "trees", "nodeFeatures", "treeFeatures", "drawShare", "balanced") == (100, -1, 0.8, 0.8, False)
    assert get("adaboost", "rounds") == (100,) and get("logistic", "regParam") == (1 / 50,)
    assert get("linear_svc", "cost", "maxIter") == (1.0, 5000) and get("decision_tree", "balanced") == (True,)


def direct_cart(x, y, weights):
    """Exact Gini splits half-way between neighbouring values, the first feature and value among equals."""
    c = np.array([(y == 0).sum(), (y == 1).sum()]) * weights
    pure = lambda v: (v * v).sum() / v.sum()
    best = (-1.0,)
    if (c > 0).all():
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                go = x[:, f] <= low
                left = np.array([(go & (y == k)).sum() for k in (0, 1)]) * weights
                gain = pure(left) + pure(c - left) - pure(c)
                if gain > best[0]:
                    best = gain, f, low / 2 + high / 2
    if len(best) == 1:
        return round(c[1] / c.sum(), 9)
    gain, f, cut = best
    go = x[:, f] <= cut
    return f, round(float(cut), 9), round(gain, 6), direct_cart(x[go], y[go], weights), direct_cart(x[~go], y[~go], weights)


@pytest.mark.parametrize("local_rows", [10_000, 60, 0])
@pytest.mark.parametrize("balanced", [False, True])
def test_exact_tree_equals_direct_version(spark, local_rows, balanced):
    rng = np.random.RandomState(8)
    n = 40 if local_rows == 0 else 240
    x = np.column_stack([rng.normal(size=n).round(1), rng.randint(0, 2, n), np.ones(n), rng.normal(size=n), rng.randint(-3, 4, n) * 0.1])
    y = ((x[:, 0] + x[:, 4] * 5 + rng.normal(size=n) * 0.5) > 0.3).astype(int)
    rows = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(n)], "x array<double>, label int").withColumn("features", array_to_vector("x"))
    model = ExactTree(balanced=balanced, localRows=local_rows, maxDepth=3 if local_rows == 0 else 1 << 30).fit(rows.repartition(3))
    ((_, nodes),) = [t for some in model.batches() for t in some]

    def shape(at, depth):
        node = nodes[at]
        if node["feature"] < 0:
            return round(float(node["value"]), 9)
        return int(node["feature"]), round(float(node["cut"]), 9), round(float(node["gain"]), 6), shape(node["left"], depth + 1), shape(node["right"], depth + 1)

    def cut_off(tree, depth, x, y):
        """A tree no deeper than 3."""
        if not isinstance(tree, tuple):
            return tree
        if depth == 3:
            w = np.array([(y == 0).sum(), (y == 1).sum()]) * weights
            return round(w[1] / w.sum(), 9)
        go = x[:, tree[0]] <= tree[1]
        return (*tree[:3], cut_off(tree[3], depth + 1, x[go], y[go]), cut_off(tree[4], depth + 1, x[~go], y[~go]))

    counts = np.bincount(y)
    weights = n / (2 * counts) if balanced else np.ones(2)
    expected = direct_cart(x, y, weights)
    assert shape(0, 0) == (cut_off(expected, 0, x, y) if local_rows == 0 else expected)


def test_exact_tree_of_one_class_or_equal_rows(spark):
    rows = spark.createDataFrame([([1.0, 2.0], i % 2) for i in range(8)], "x array<double>, label int").withColumn("features", array_to_vector("x"))
    for local_rows in (0, 100):
        same = ExactTree(localRows=local_rows).fit(rows).transform(rows).select(vector_to_array("probability")[1].alias("p")).collect()
        assert [r["p"] for r in same] == [0.5] * 8
        one = ExactTree(localRows=local_rows).fit(rows.where("label = 1")).transform(rows)
        assert {r["prediction"] for r in one.collect()} == {1.0}


def test_naive_bayes_equals_direct_version(spark):
    rng = np.random.RandomState(4)
    x = np.column_stack([rng.normal(size=200), rng.randint(0, 2, 200), np.full(200, 3.0), rng.normal(size=200) * 50])
    y = (x[:, 0] + rng.normal(size=200) > 0.4).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(200)], "id int, x array<double>, label int")
    rows = rows.withColumn("features", array_to_vector("x")).repartition(3)
    model = GaussianBayes().fit(rows)
    more = 1e-9 * x.var(axis=0).max()
    logs = np.column_stack([
        np.log((y == k).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == k].var(axis=0) + more))
                                         + (x - x[y == k].mean(axis=0)) ** 2 / (x[y == k].var(axis=0) + more)).sum(axis=1)
        for k in (0, 1)
    ])
    out = model.transform(rows).select("id", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("raw"), "prediction").orderBy("id").collect()
    assert np.allclose([r["raw"] for r in out], logs, rtol=1e-9)
    assert np.allclose([r["p"][1] for r in out], 1 / (1 + np.exp(logs[:, 0] - logs[:, 1])))
    assert [r["prediction"] for r in out] == (logs[:, 1] > logs[:, 0]).astype(float).tolist()
    with pytest.raises(ValueError):
        GaussianBayes().fit(rows.where("label = 1"))


@pytest.mark.parametrize("weighted", [False, True])
def test_squared_hinge_equals_dense_solution(spark, weighted):
    rng = np.random.RandomState(6)
    x = rng.normal(size=(300, 4)) * [1, 2, 0.5, 1]
    y = (x @ [1, -0.5, 0.3, 0] + rng.normal(size=300) > 0.8).astype(int)
    u = np.where(y == 1, 3.0, 1.0) if weighted else np.ones(300)
    rows = spark.createDataFrame([(x[i].tolist(), int(y[i]), float(u[i])) for i in range(300)], "x array<double>, label int, w double")
    rows = rows.withColumn("features", array_to_vector("x")).repartition(3)
    model = SquaredHingeSvm(weightCol="w" if weighted else "").fit(rows)
    a, s = np.column_stack([x, np.ones(300)]), 2.0 * y - 1
    w = np.array([*model.getOrDefault("coefficients"), model.getOrDefault("intercept")])
    assert model.gradient_per_weight < 1e-8

    def objective(w):
        return 0.5 * w @ w + (u * np.maximum(1 - s * (a @ w), 0) ** 2).sum()

    slack = np.maximum(1 - s * (a @ w), 0)
    assert np.abs(w - 2 * a.T @ (u * s * slack)).max() < 1e-6  # the gradient
    # duality: the dual objective of the multipliers that the solution implies equals the primal one
    alpha = 2 * u * slack
    v = a.T @ (alpha * s)
    dual = alpha.sum() - 0.5 * v @ v - (alpha * alpha / (4 * u)).sum()
    assert objective(w) == pytest.approx(dual, rel=1e-8)
    solution = np.zeros(5)
    for _ in range(100):
        active = 1 - s * (a @ solution) > 0
        gradient = solution - 2 * a.T @ (u * s * np.maximum(1 - s * (a @ solution), 0))
        step = np.linalg.solve(np.eye(5) + 2 * (a[active] * u[active, None]).T @ a[active], gradient)
        length = 1.0
        while objective(solution - length * step) > objective(solution) and length > 1e-12:
            length /= 2
        solution = solution - length * step
    assert np.allclose(w, solution, atol=1e-7)
    assert np.allclose([r["m"] for r in model.transform(rows).select(vector_to_array("rawPrediction")[1].alias("m"), "x").orderBy("x").collect()],
                       (a @ w)[np.lexsort(x.T[::-1])])


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    folder = scratch_path(spark, "artifacts")
    rows = credit_table(spark, sf_dir)
    result = train.train_all(
        rows, CREDIT_AS_OF, folder=folder, names=["linear_svc", "naive_bayes"], k=2, sizes=SMALL,
        primary="test_f1_0", secondary="test_accuracy", curve_fractions=[0.5],
    )
    yield rows, result, folder
    result.release()


def test_training_job(trained):
    _, result, _ = trained
    board = result.leaderboard.collect()
    assert [r["position"] for r in board] == [1, 2] and board[0]["model"] == result.best_name
    assert {r["part"] for r in result.parts.collect()} == {"train", "test", "fold_1", "fold_2"}
    assert result.report.count() == 5
    assert [c.first()["fraction"] for c in result.curves.values()] == [0.5, 0.5]
    assert evaluate.confusion_on(result.models["naive_bayes"], result.test).count() == 4


def test_a_run_that_died_goes_on(spark, sf_dir, monkeypatch):
    folder, rows, calls = scratch_path(spark, "resumed"), credit_table(spark, sf_dir), []
    real = train.evaluate_classifier

    def dying(name, *given, **settings):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(name)
        return real(name, *given, **settings)

    names = ["naive_bayes", "linear_svc", "adaboost"]
    job = {"folder": folder, "names": names, "k": 2, "sizes": SMALL, "primary": "test_f1_0", "secondary": "test_accuracy", "parallelism": 1}
    monkeypatch.setattr(train, "evaluate_classifier", dying)
    with pytest.raises(RuntimeError):
        train.train_all(rows, CREDIT_AS_OF, **job)
    assert calls == names[:2]
    calls.clear()
    result = train.train_all(rows, CREDIT_AS_OF, **job)
    assert calls == ["adaboost"] and result.leaderboard.count() == 3
    board = [tuple(r) for r in result.leaderboard.collect()]
    calls.clear()
    again = train.train_all(rows, CREDIT_AS_OF, **job)
    assert calls == [] and [tuple(r) for r in again.leaderboard.collect()] == board
    with pytest.raises(RuntimeError):  # other data: nothing of the ledger holds
        train.train_all(rows.where("loan_id % 3 > 0"), CREDIT_AS_OF, **job)
    assert calls == names[:2]


@pytest.mark.parametrize("name", ["naive_bayes", "adaboost"])
def test_model_curve_equals_fits_one_by_one(spark, sf_dir, name):
    rows, _, _ = train.prepare(credit_table(spark, sf_dir), CREDIT_AS_OF)
    rows = rows.cache()
    found = evaluate.model_curve(name, rows, [0.3, 1.0], k=2, sizes=SMALL).orderBy("fold", "fraction").collect()
    each = evaluate.learning_curve(lambda some: fit_classifier(name, some, S.TARGET, sizes=SMALL), rows, [0.3, 1.0], k=2).orderBy("fold", "fraction").collect()
    assert [(r["fold"], r["fraction"]) for r in found] == [(r["fold"], r["fraction"]) for r in each]
    tolerance = 0.05 if name == "adaboost" else 1e-9  # cuts are quantiles of the rows of all models, or of one
    for a, b in zip(found, each):
        assert a["train_score"] == pytest.approx(b["train_score"], abs=tolerance)
        assert a["validation_score"] == pytest.approx(b["validation_score"], abs=tolerance)


def test_cross_validation_of_several_models(spark, separable):
    folded = separable.withColumn("fold", (F.col(S.KEY) % 3 + 1).cast("int"))
    found = evaluate.cross_validated(["naive_bayes", "random_forest"], folded, "y", k=3, sizes=SMALL).collect()
    assert sorted((r["model"], r["fold"]) for r in found) == [(m, i) for m in ("naive_bayes", "random_forest") for i in (1, 2, 3)]
    assert all(r["roc_auc"] > 0.8 for r in found)


def test_cross_validation_fits_the_models_it_scores(spark, separable, monkeypatch):
    from riskweave.operators import models
    from riskweave.operators.tree_models import ForestClassifier

    grown, fitted = [], []
    grow, fit = ForestClassifier.grown, models.fit_classifier
    monkeypatch.setattr(ForestClassifier, "grown", lambda self, blocks, some: grown.append(some) or grow(self, blocks, some))
    monkeypatch.setattr(models, "fit_classifier", lambda *given: fitted.append(given[0]) or fit(*given))
    folded = separable.withColumn("fold", (F.col(S.KEY) % 3 + 1).cast("int"))
    evaluate.cross_validated(["naive_bayes", "random_forest"], folded, "y", k=3, sizes=SMALL)
    assert grown == [[1, 2, 3]] and fitted == ["naive_bayes"] * 3
    with_all = models.fit_parts("random_forest", folded, "y", [1, 2, 3], sizes=SMALL)
    without = models.fit_parts("random_forest", folded, "y", [1, 2, 3], sizes=SMALL, whole=False)
    assert sorted(with_all) == [0, 1, 2, 3] and sorted(without) == [1, 2, 3]
    p = [m.transform(folded).orderBy(S.KEY).select(vector_to_array("probability")[1].alias("p")).collect() for m in (with_all[2], without[2])]
    assert p[0] == p[1]


def test_first_candidate_is_loaded_and_described(spark, trained):
    _, _, folder = trained
    name, model, features = artifacts.load_first(folder)
    assert name == "model_linear_svc"
    row = artifacts.describe_model(spark, model, features).first()
    assert row["model_name"] == "LinearMargin" and row["features_count"] > 13
    assert row["stages"][0] == "DropColumns"
    with pytest.raises(FileNotFoundError):
        artifacts.load_first(folder + "-nowhere")


def test_margin_scores_become_probabilities(trained):
    rows, _, folder = trained
    _, model, features = artifacts.load_first(folder)
    usable, excluded = score.split_excluded(rows, features)
    scored = score.score_records(usable, features, model)
    assert scored.count() + excluded.count() == rows.count()
    assert set(rows.columns) < set(scored.columns)
    raw = model.transform(features.transform(usable)).select(S.KEY, vector_to_array("rawPrediction")[1].alias("margin"))
    joined = scored.join(raw, S.KEY).withColumn("gap", F.abs(F.col("probability") - 1 / (1 + F.exp(-F.col("margin")))))
    assert joined.agg(F.max("gap")).first()[0] < 1e-12


def test_stored_evaluation_without_own_probability(trained):
    rows, _, folder = trained
    _, model, features = artifacts.load_first(folder)
    usable, _ = score.split_excluded(rows, features)
    done = evaluate.evaluate_stored(usable, features, model)
    assert done.where("probability is not null").count() == 0 and done.count() == usable.count()


def test_learning_curve_has_all_sizes_and_times(separable):
    rows = separable.select(S.KEY, F.col("y").alias(S.TARGET), "features")
    curve = evaluate.learning_curve(
        lambda r: fit_classifier("naive_bayes", r, S.TARGET), rows, [0.5, 1.0], k=2
    )
    assert curve.count() == 4
    summary = {r["fraction"]: r for r in evaluate.learning_curve_summary(curve).collect()}
    assert set(summary) == {0.5, 1.0} and summary[1.0]["fit_seconds_mean"] > 0
    gap = summary[1.0]["train_score_mean"] - summary[1.0]["validation_score_mean"]
    assert summary[1.0]["gap"] == pytest.approx(gap)


def test_importances_carry_names(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("double").alias("good"), F.lit(1.0).alias("flat"), (F.col("id") % 2).cast("int").alias("y"))
    rows = VectorAssembler(inputCols=["flat", "good"], outputCol="features").transform(rows)
    model = fit_classifier("decision_tree", rows, "y", sizes=SMALL)
    assert metrics.top_importances(model, rows, limit=1).first()["feature"] == "good"


@pytest.mark.parametrize("stages", ["usual", "younger", "other types"])
def test_scored_and_excluded_make_the_whole_input(spark, sf_dir, stages):
    """Limits come from the fitted stages, whatever they are."""
    rows = credit_table(spark, sf_dir)
    pipeline = base_pipeline(CREDIT_AS_OF)
    if stages == "younger":
        pipeline = Pipeline(stages=[cleaning.KeepBelow(limit=60.0) if isinstance(s, cleaning.KeepBelow) else s for s in pipeline.getStages()])
    if stages == "other types":
        pipeline = Pipeline(stages=[cleaning.ExcludeCategories(values=["04"]) if isinstance(s, cleaning.ExcludeCategories) else s for s in pipeline.getStages()])
    fitted = pipeline.fit(rows)
    scored, excluded = score.score_batch(rows, fitted, PipelineModel(stages=[HeuristicClassifier()]))
    assert scored.count() + excluded.count() == rows.count()
    assert scored.select(S.KEY).intersect(excluded.select(S.KEY)).isEmpty() and not excluded.isEmpty()


def test_registered_training_has_full_size(monkeypatch):
    from types import SimpleNamespace

    from riskweave.catalog import queries
    from riskweave.operators.models import Sizes

    calls = []
    monkeypatch.setattr(queries, "credit_table", lambda spark, d: "credit")
    monkeypatch.setattr(queries.train, "train_all", lambda *given, **named: calls.append((given, named)) or SimpleNamespace(leaderboard="board"))
    assert queries.training_leaderboard(None, "") == "board" and calls == [(("credit", queries.CREDIT_AS_OF), {})]
    assert queries.QUERY_SIZES == Sizes()


def test_curve_of_models_fitted_together_equals_one_by_one(separable):
    from riskweave.operators.bayes import predicted_together
    from riskweave.operators.models import build_classifier

    rows, fits = separable.select(S.KEY, F.col("y").alias(S.TARGET), "features").cache(), []

    def together(some, members, models):
        fits.append(models)
        return build_classifier("naive_bayes", 0, S.TARGET).fit_members(some, members, models)

    def curve(**given):
        found = evaluate.learning_curve(lambda r: fit_classifier("naive_bayes", r, S.TARGET), rows, [0.3, 0.7, 1.0], k=3, **given)
        return found.drop("fit_seconds", "score_seconds").orderBy("fold", "fraction").collect()

    assert curve(together=(together, lambda models: predicted_together(models, F.col("features")))) == curve()
    assert fits == [9]
