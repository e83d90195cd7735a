"""Registered queries: every operator on the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import schema as S
from riskweave.functions import risk, scalars
from riskweave.operators import certificates, cleaning, drift, encoding, exact_tree, heuristic, leaderboard, metrics, splits, summaries, validation
from riskweave.operators.bayes import predicted_together
from riskweave.operators.exact_tree import ExactTree
from riskweave.operators.models import MODEL_NAMES, Sizes, build_classifier, class_counts, fit_classifier, fit_classifiers, scored_rows
from riskweave.plans import baseline, evaluate, features, score, train
from riskweave.session import materialised, scratch_path
from riskweave.sources import artifacts, credit, prediction_log
from riskweave.sources.derived import CREDIT_AS_OF, LOG_AS_OF, credit_table, fixed_score
from riskweave.sources.derived import prediction_log as derived_log
from riskweave.streaming import scoring as streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


# The registered training queries have the full sizes.
QUERY_SIZES = Sizes()


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Label, fixed score and prediction of every loan, plus the named columns."""
    rows = fixed_score(credit_table(spark, d, [*columns, S.TARGET]))
    return rows.withColumnRenamed(S.TARGET, "label")


def banded(spark: SparkSession, d: str) -> DataFrame:
    """Every loan as a scored row with its risk band."""
    rows = fixed_score(credit_table(spark, d, ["tipo_laboral"]))
    return risk.with_risk(rows.withColumnRenamed("score", "probability"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- sources and sinks -------------------------------------------------------


@register
def credit_load(spark, d):
    return credit_table(spark, d)


@register
def credit_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    first = credit.load_with_snapshot(spark, lambda: credit_table(spark, d), path)
    again = credit.load_with_snapshot(spark, lambda: first, path, use_snapshot=True)
    return again


@register
def scoring_csv(spark, d):
    path = scratch_path(spark, "scoring") + ".csv"
    credit_table(spark, d).write.option("header", True).csv(path)
    return credit.read_scoring_file(spark, path).drop(validation.BROKEN)


@register
def record_batch(spark, d):
    path = scratch_path(spark, "records")
    credit_table(spark, d).write.json(path)
    return credit.read_record_files(spark, path).drop(validation.BROKEN)


@register
def log_append(spark, d):
    location = scratch_path(spark, "log")
    name = "prediction_log_" + location[-32:]
    prediction_log.create_log(spark, name, location)
    prediction_log.create_log(spark, name, location)
    rows = credit_table(spark, d, [*S.LOGGED_FEATURES, "tipo_laboral"])
    results = risk.with_risk(fixed_score(rows).withColumnRenamed("score", "probability"))
    # one row in seven arrives without a result and takes the defaults
    answered = F.col(S.KEY) % 7 != 0
    results = results.withColumns(
        {c: F.when(answered, F.col(c)) for c in ("prediction", "probability", "risk_level")}
    )
    for _ in range(2):  # the repeated append replaces its own batch
        prediction_log.insert_predictions(results, name, "batch-1", LOG_AS_OF)
    log = spark.table(name)
    return log.select(
        "id", F.col("timestamp").cast("string").alias("timestamp"), "input_data",
        "prediction", "probability", "risk_level", *S.LOGGED_FEATURES, F.col("log_date").cast("string").alias("log_date"),
    )


@register
def log_recent_week(spark, d):
    return prediction_log.newest_first(derived_log(spark, d), 7, LOG_AS_OF).drop("input_data")


# --- projections, filters, predicates ----------------------------------------


@register
def drop_columns(spark, d):
    stage = cleaning.DropColumns(columns=[*S.SPARSE_COLUMNS, *S.UNUSED_COLUMNS, "not_there"])
    return stage.transform(credit_table(spark, d))


@register
def outlier_filter(spark, d):
    return cleaning.KeepBelow().transform(credit_table(spark, d, ["edad_cliente"]))


@register
def category_exclusion(spark, d):
    rows = credit_table(spark, d, ["tipo_credito"])
    rows = rows.withColumn("tipo_credito", F.when(F.col(S.KEY) % 11 != 0, F.col("tipo_credito")))
    return cleaning.ExcludeCategories().transform(rows)


@register
def category_cast(spark, d):
    rows = credit_table(spark, d, ["tipo_laboral", "tipo_credito", "huella_consulta"])
    return cleaning.AsCategory(columns=["huella_consulta", "tipo_credito", "not_there"]).transform(rows)


@register
def label_split(spark, d):
    rows = credit_table(spark, d, ["capital_prestado", S.TARGET])
    return rows.select(S.KEY, F.col(S.TARGET).cast("int").alias("label"))


@register
def present_fields(spark, d):
    rows = credit.present_fields(credit_table(spark, d))
    return rows.select(
        S.KEY,
        F.size(F.json_object_keys("record")).alias("fields"),
        F.get_json_object("record", "$.tendencia_ingresos").alias("tendencia_ingresos"),
    )


@register
def error_cases(spark, d):
    return metrics.error_cases(scored(spark, d, "tipo_laboral", "capital_prestado"), S.KEY)


@register
def recent_view(spark, d):
    return summaries.recent_view(prediction_log.recent_log(derived_log(spark, d), 3, LOG_AS_OF))


@register
def recent_lines(spark, d):
    return summaries.recent_lines(prediction_log.recent_log(derived_log(spark, d), 3, LOG_AS_OF))


@register
def response_rows(spark, d):
    return summaries.first_rows(banded(spark, d), S.KEY)


@register
def rule_violations(spark, d):
    checked = validation.with_violations(credit_table(spark, d))
    return checked.select(S.KEY, F.concat_ws(",", "violations").alias("violations"))


@register
def rejected_records(spark, d):
    _, rejected = validation.split_valid(credit_table(spark, d))
    return rejected.select(S.KEY, F.size("violations").alias("broken_rules"))


@register
def validation_totals(spark, d):
    return validation.check_totals(validation.check_results(credit_table(spark, d)))


@register
def validation_failures(spark, d):
    return validation.failing_checks(validation.check_results(credit_table(spark, d)))


# --- alignments --------------------------------------------------------------


@register
def surviving_labels(spark, d):
    rows = cleaning.KeepBelow().transform(credit_table(spark, d, ["edad_cliente"]))
    return cleaning.labels_of(credit_table(spark, d, [S.TARGET]), rows)


@register
def attach_label(spark, d):
    labelled = cleaning.KeepBelow().transform(credit_table(spark, d, ["edad_cliente", S.TARGET]))
    return cleaning.attach_labels(credit_table(spark, d, ["capital_prestado"]), labelled.drop("edad_cliente"))


@register
def attach_predictions(spark, d):
    return scored(spark, d, "capital_prestado", "tipo_laboral")


# --- scalar functions --------------------------------------------------------


@register
def parsed_dates(spark, d):
    rows = credit_table(spark, d, ["fecha_prestamo"])
    text = F.date_format("fecha_prestamo", "yyyy-MM-dd")
    broken = F.when(F.col(S.KEY) % 5 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return rows.select(S.KEY, F.to_date(scalars.parse_date(broken)).cast("string").alias("parsed"))


@register
def loan_date_features(spark, d):
    return cleaning.LoanDateFeatures(asOf=CREDIT_AS_OF).transform(
        credit_table(spark, d, ["fecha_prestamo"])
    ).drop("fecha_prestamo")


@register
def heuristic_predictions(spark, d):
    return baseline.baseline_predictions(credit_table(spark, d), CREDIT_AS_OF).select(S.KEY, S.TARGET, "prediction")


@register
def risk_bands(spark, d):
    return rounded(banded(spark, d), 6, "risk_score").drop("prediction", "tipo_laboral")


@register
def margin_probability(spark, d):
    rows = fixed_score(credit_table(spark, d, []))
    return rows.select(S.KEY, F.round(risk.sigmoid(F.col("score") * 8 - 4), 9).alias("probability"))


@register
def fallback_probability(spark, d):
    rows = fixed_score(credit_table(spark, d, []))
    return rows.select(S.KEY, risk.fallback_probability(F.col("prediction")).alias("probability"))


@register
def percentage_change(spark, d):
    rows = credit_table(spark, d, ["saldo_mora", "saldo_principal"])
    change = scalars.pct_change(F.col("saldo_mora"), F.col("saldo_principal"))
    return rows.select(S.KEY, F.round(change, 6).alias("change_pct"))


@register
def approval_rates(spark, d):
    pays = F.count(F.when(F.col("prediction") == 1, 1))
    return banded(spark, d).groupBy("tipo_laboral").agg(
        scalars.pct(pays, F.count(F.lit(1))).alias("payer_pct"),
        F.round(F.avg("probability"), 4).alias("mean_probability"),
    )


@register
def stability_classes(spark, d):
    rows = fixed_score(credit_table(spark, d, ["huella_consulta"]))
    return rows.select(
        S.KEY,
        risk.stability(
            F.col("score"), F.lit(0.5), F.col("huella_consulta") / 10, F.lit(0.45)
        ).alias("stability"),
    )


@register
def display_formats(spark, d):
    log = derived_log(spark, d)
    return log.select(
        "id",
        scalars.short_time(F.col("timestamp")).alias("at"),
        scalars.money(F.col("edad_cliente") * 12345.0).alias("amount"),
        scalars.three_decimals(F.col("probability")).alias("probability"),
    )


@register
def class_text_tests(spark, d):
    return banded(spark, d).select(
        S.KEY,
        risk.is_high_risk(F.col("risk_level")).alias("high_risk"),
        risk.is_approved(F.col("recommendation")).alias("approved"),
        risk.colour_tier(F.col("risk_level")).alias("tier"),
        risk.decision_name(F.col("prediction")).alias("decision"),
        risk.class_name(F.col("prediction")).alias("class"),
    )


@register
def logged_inputs(spark, d):
    return prediction_log.parsed_inputs(derived_log(spark, d), "k int")


@register
def log_days(spark, d):
    return derived_log(spark, d).select("id", scalars.as_day(F.col("timestamp")).cast("string").alias("day"))


# --- aggregations ------------------------------------------------------------


@register
def imputation_values(spark, d):
    fitted = cleaning.MissingValueFiller().fit(credit_table(spark, d))
    return spark.createDataFrame([fitted.fills()], ", ".join(f"{c} double" for c in fitted.fills()))


@register
def imputed_columns(spark, d):
    rows = credit_table(spark, d, [*S.MEDIAN_COLUMNS, *S.MEAN_COLUMNS])
    return rounded(cleaning.MissingValueFiller().fit(rows).transform(rows), 6, *S.MEAN_COLUMNS)


@register
def class_balance(spark, d):
    return rounded(
        summaries.class_balance(credit_table(spark, d, [S.TARGET]), S.TARGET), 6, "share_0", "share_1", "positive_weight"
    )


@register
def balanced_weights(spark, d):
    return rounded(summaries.balanced_weights(credit_table(spark, d, [S.TARGET]), S.TARGET), 6, "weight")


@register
def weighted_rows(spark, d):
    return rounded(summaries.with_balanced_weights(credit_table(spark, d, [S.TARGET]), S.TARGET), 6, "weight")


@register
def scoring_summary(spark, d):
    return summaries.scoring_summary(banded(spark, d))


@register
def file_scoring_summary(spark, d):
    return summaries.file_scoring_summary(banded(spark, d))


@register
def log_summary(spark, d):
    log = prediction_log.recent_log(derived_log(spark, d), 7, LOG_AS_OF)
    summary = summaries.log_summary(log)
    entries = F.transform(
        F.array_sort(F.map_entries("risk_distribution")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    summary = summary.withColumn("risk_distribution", F.concat_ws(";", entries))
    return rounded(summary, 4, "approval_rate", "avg_probability", "avg_loan_amount", "avg_credit_score")


@register
def risk_counts(spark, d):
    return summaries.value_counts(derived_log(spark, d), "risk_level")


@register
def daily_counts(spark, d):
    daily = summaries.daily_counts(prediction_log.recent_log(derived_log(spark, d), 14, LOG_AS_OF))
    return daily.withColumn("day", F.col("day").cast("string"))


@register
def amount_histogram(spark, d):
    log = prediction_log.recent_log(derived_log(spark, d), 14, LOG_AS_OF)
    return rounded(summaries.amount_histogram(log), 4, "low_edge")


@register
def probability_histogram(spark, d):
    return metrics.probability_histogram(scored(spark, d))


@register
def predictions_by_class(spark, d):
    return metrics.predictions_by_class(scored(spark, d))


@register
def probability_over_time(spark, d):
    return summaries.probability_over_time(prediction_log.recent_log(derived_log(spark, d), 14, LOG_AS_OF))


@register
def yearly_total(spark, d):
    log = prediction_log.recent_log(derived_log(spark, d), 365, LOG_AS_OF)
    return log.agg(F.count(F.lit(1)).alias("total_predictions"))


def fold_scores(spark, d, k: int = 5) -> DataFrame:
    rows = fixed_score(credit_table(spark, d, [S.TARGET]))
    return splits.stratified_folds(rows, k).withColumnRenamed(S.TARGET, "label")


@register
def fold_metric_description(spark, d):
    folds = metrics.class_metrics(fold_scores(spark, d, 10), ["fold"])
    return leaderboard.describe_metrics(folds, ["accuracy", "precision_1", "recall_1", "f1_1"], digits=6)


@register
def segment_performance(spark, d):
    return rounded(metrics.segment_performance(scored(spark, d, "tipo_laboral")), 6, "accuracy", "precision", "recall")


@register
def executive_summary(spark, d):
    return rounded(metrics.executive_summary(scored(spark, d)), 6, "accuracy_pct")


@register
def error_rate(spark, d):
    return rounded(metrics.error_rate(scored(spark, d)), 6, "error_rate")


@register
def drift_features(spark, d):
    found = drift.drift_by_feature(derived_log(spark, d), LOG_AS_OF)
    return rounded(found.drop("p_value"), 6, "recent_mean", "older_mean", "change_pct", "t_stat")


@register
def drift_p_values(spark, d):
    found = drift.drift_by_feature(derived_log(spark, d), LOG_AS_OF).select("feature", "t_stat", "p_value")
    return rounded(found, 6, "t_stat", "p_value")


@register
def drift_totals(spark, d):
    return drift.drift_totals(drift.drift_by_feature(derived_log(spark, d), LOG_AS_OF))


@register
def drift_status(spark, d):
    return drift.drift_status(derived_log(spark, d), LOG_AS_OF)


# --- classification metrics --------------------------------------------------


@register
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(scored(spark, d))


@register
def overall_metrics(spark, d):
    return rounded(
        metrics.overall_metrics(scored(spark, d)), 6, "accuracy", "weighted_precision", "weighted_recall", "weighted_f1"
    )


@register
def class_metrics(spark, d):
    found = metrics.class_metrics(scored(spark, d))
    return rounded(found, 6, *found.columns)


@register
def classification_report(spark, d):
    return metrics.classification_report(scored(spark, d))


@register
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(scored(spark, d)), 6, "fpr", "tpr")


@register
def roc_auc(spark, d):
    return rounded(metrics.curve_areas(scored(spark, d)).select("roc_auc"), 6, "roc_auc")


@register
def precision_recall_curve(spark, d):
    return rounded(metrics.precision_recall_curve(scored(spark, d)), 6, "precision", "recall", "baseline")


@register
def average_precision(spark, d):
    return rounded(metrics.curve_areas(scored(spark, d)).select(F.col("pr_auc").alias("average_precision")), 6, "average_precision")


# --- features and splits -----------------------------------------------------


@register
def base_features(spark, d):
    rows = credit_table(spark, d)
    cleaned = features.base_pipeline(CREDIT_AS_OF).fit(rows).transform(rows)
    return rounded(cleaned, 6, "puntaje_datacredito")


@register
def reloaded_base_features(spark, d):
    rows = credit_table(spark, d)
    path = scratch_path(spark, "stages")
    features.base_pipeline(CREDIT_AS_OF).fit(rows).write().save(path)
    return rounded(PipelineModel.load(path).transform(rows), 6, "puntaje_datacredito")


@register
def standardised_columns(spark, d):
    rows = credit_table(spark, d)
    rows = features.base_pipeline(CREDIT_AS_OF).fit(rows).transform(rows).select(S.KEY, *S.NUMERIC_FEATURES)
    done = encoding.PopulationScaler(columns=S.NUMERIC_FEATURES).fit(rows).transform(rows).drop(*S.NUMERIC_FEATURES)
    return rounded(done, 6, *[f"num__{c}" for c in S.NUMERIC_FEATURES])


@register
def design_matrix_totals(spark, d):
    """Sum of every named column of the design matrix over the table."""
    rows = credit_table(spark, d)
    design = features.ml_pipeline(CREDIT_AS_OF).fit(rows).transform(rows).select("features")
    names = F.array(*[F.lit(n) for n in encoding.feature_names(design)])
    cells = design.select(F.explode(F.arrays_zip(names.alias("name"), vector_to_array("features").alias("value"))).alias("c"))
    # adding 0 turns the negative zero of a rounded sum into zero
    return cells.groupBy(F.col("c.name").alias("feature")).agg((F.round(F.sum("c.value"), 3) + F.lit(0.0)).alias("total"))


@register
def design_matrix(spark, d):
    rows = credit_table(spark, d)
    design = features.ml_pipeline(CREDIT_AS_OF).fit(rows).transform(rows)
    cells = design.select(S.KEY, F.posexplode(vector_to_array("features")).alias("place", "value"))
    return cells.withColumn("value", F.round("value", 6) + F.lit(0.0))


@register
def stratified_split(spark, d):
    return splits.mark_test_rows(credit_table(spark, d, [S.TARGET]))


@register
def stratified_folds(spark, d):
    return splits.stratified_folds(credit_table(spark, d, [S.TARGET]))


@register
def shuffle_splits(spark, d):
    copies = splits.shuffle_splits(credit_table(spark, d, [S.TARGET]))
    return copies.groupBy("repeat", "is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.KEY).alias("key_sum"), F.sum(S.TARGET).alias("positives")
    )


# --- evaluation --------------------------------------------------------------


@register
def fold_metrics(spark, d):
    found = metrics.detailed_metrics(fold_scores(spark, d), ["fold"])
    return rounded(found, 6, *leaderboard.DETAILED)


@register
def fold_metric_spread(spark, d):
    spread = leaderboard.fold_spread(metrics.detailed_metrics(fold_scores(spark, d), ["fold"]))
    return rounded(spread, 6, *spread.columns)


@register
def cross_validation_report(spark, d):
    detailed = metrics.detailed_metrics(fold_scores(spark, d), ["fold"])
    report = leaderboard.report_spread(evaluate.cross_validation_report(detailed), evaluate.MODEL_REPORT)
    return rounded(report, 6, "mean", "std", "min", "max")


# Multipliers of the fixed score that stand in for differently good models.
RULE_MODELS = {"m7919": 7919, "m37": 37, "m611": 611}


def model_parts(spark, d) -> DataFrame:
    """Metrics per (model, part) of three fixed scores over all loans."""
    train_rows, test_rows = splits.stratified_split(credit_table(spark, d, [S.TARGET]))
    folded = splits.stratified_folds(train_rows)
    rows = folded.unionByName(test_rows.withColumn("fold", F.lit(None).cast("int")))
    own_fold = F.concat(F.lit("fold_"), F.col("fold").cast("string"))
    parts = F.when(F.col("fold").isNull(), F.array(F.lit("test"))).otherwise(F.array(F.lit("train"), own_fold))
    models = F.array(
        *[
            F.struct(F.lit(n).alias("model"), (((F.col(S.KEY) * m) % 1000).cast("double") / 1000).alias("score"))
            for n, m in RULE_MODELS.items()
        ]
    )
    long = (
        rows.select(F.col(S.TARGET).alias("label"), S.KEY, F.explode(parts).alias("part"))
        .select("label", "part", F.inline(models.alias("m")))
        .withColumn("prediction", (F.col("score") >= 0.2).cast("int"))
    )
    return metrics.detailed_metrics(long, ["model", "part"])


@register
def model_results(spark, d):
    rows = leaderboard.result_rows(model_parts(spark, d))
    return rounded(rows, 6, *[c for c in rows.columns if c not in ("model", "stability")])


@register
def model_leaderboard(spark, d):
    ranked = leaderboard.rank_models(leaderboard.result_rows(model_parts(spark, d)))
    return rounded(ranked.select("model", "position", "credit_score"), 5, "credit_score")


@register
def rule_learning_curve(spark, d):
    rows = fixed_score(credit_table(spark, d, [S.TARGET])).drop("score")
    curve = evaluate.rule_learning_curve(rows, baseline.FRACTIONS, repeats=baseline.REPEATS)
    return rounded(curve, 6, "fraction", "train_score", "validation_score")


@register
def baseline_report(spark, d):
    return baseline.run_baseline(credit_table(spark, d), CREDIT_AS_OF).report()


@register
def baseline_confusion(spark, d):
    return baseline.run_baseline(credit_table(spark, d), CREDIT_AS_OF).confusion()


@register
def baseline_learning_curve(spark, d):
    curve = baseline.run_baseline(credit_table(spark, d), CREDIT_AS_OF).learning_curve()
    return rounded(curve, 6, *curve.columns)


@register
def baseline_folds(spark, d):
    folds = baseline.run_baseline(credit_table(spark, d), CREDIT_AS_OF).folds()
    return rounded(folds, 6, "accuracy", "precision", "recall", "f1")


def rule_artifacts(spark, d) -> tuple[DataFrame, PipelineModel, PipelineModel]:
    """All loans, the fitted cleaning stages, and the rules as a loaded model."""
    rows = credit_table(spark, d)
    cleaned = features.base_pipeline(CREDIT_AS_OF).fit(rows)
    return rows, cleaned, PipelineModel(stages=[heuristic.HeuristicClassifier()])


@register
def batch_scoring(spark, d):
    rows, cleaned, model = rule_artifacts(spark, d)
    done, _ = score.score_batch(rows, cleaned, model)
    return done.select(S.KEY, "puntaje", "prediction", "probability", "risk_level", "recommendation")


@register
def excluded_from_scoring(spark, d):
    rows, cleaned, model = rule_artifacts(spark, d)
    _, excluded = score.score_batch(rows, cleaned, model)
    return excluded.select(S.KEY, F.concat_ws(",", "excluded_because").alias("excluded_because"))


@register
def labelled_evaluation(spark, d):
    rows, cleaned, model = rule_artifacts(spark, d)
    done = evaluate.evaluate_labelled(rows, cleaned, model)
    return done.select(S.KEY, S.TARGET, "prediction", "probability", "risk_level")


@register
def stored_model_evaluation(spark, d):
    rows, cleaned, model = rule_artifacts(spark, d)
    folder = scratch_path(spark, "rules")
    artifacts.save_artifacts(folder, {"logistic": model}, "logistic", cleaned)
    _, loaded, loaded_features = artifacts.load_first(folder)
    usable, _ = score.split_excluded(rows, loaded_features)
    return evaluate.evaluate_stored(usable, loaded_features, loaded).select(S.KEY, "prediction", "probability")


@register
def first_stored_model(spark, d):
    """Of several stored models the one that is looked for first: here the rules, beside a stage that predicts nothing."""
    rows, cleaned, model = rule_artifacts(spark, d)
    folder = scratch_path(spark, "several")
    artifacts.save_artifacts(folder, {"naive_bayes": cleaned, "logistic": model, "bagging": cleaned}, "naive_bayes", cleaned)
    name, loaded, loaded_features = artifacts.load_first(folder)
    usable, _ = score.split_excluded(rows, loaded_features)
    return evaluate.evaluate_stored(usable, loaded_features, loaded).select(S.KEY, F.lit(name).alias("name"), "prediction")


# --- models ------------------------------------------------------------------


def trained_on_table(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train_rows, test_rows, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)
        model = fit_classifier(name, materialised(train_rows, "train"), S.TARGET, sizes=QUERY_SIZES)
        rows = scored_rows(model, test_rows, S.TARGET).withColumn("model", F.lit(name))
        measured = metrics.detailed_metrics(rows, ["model"])
        return rounded(measured, 6, *[c for c in measured.columns if c != "model"])

    query.__name__ = f"train_{name}"
    return query


for _name in MODEL_NAMES:
    register(trained_on_table(_name))


@register
def decision_tree_splits(spark, d):
    """The root's split and those of its children, from attribute lists alone."""
    train_rows, _, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)
    model = ExactTree(labelCol=S.TARGET, balanced=True, maxDepth=2, localRows=0).fit(train_rows)
    return exact_tree.described_splits(model)


def fitted_linear(spark, d, name: str) -> tuple[Model, DataFrame, Column, list[str]]:
    """A linear model, the rows it was fitted on, their weights and the names of their features."""
    train_rows, _, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)
    names = encoding.feature_names(train_rows)
    train_rows = materialised(train_rows, "train")
    counts = class_counts(train_rows, S.TARGET)
    weight = F.when(F.col(S.TARGET) == 1, sum(counts.values()) / (2 * counts[1])).otherwise(sum(counts.values()) / (2 * counts[0]))
    return fit_classifier(name, train_rows, S.TARGET), train_rows, weight, names


@register
def logistic_certificate(spark, d):
    """The gradient of the penalised loss at the fitted coefficients, which is zero at the optimum, to four digits."""
    model, rows, weight, names = fitted_linear(spark, d, "logistic")
    found = certificates.logistic_gradient(model, rows, S.TARGET, weight, names)
    return found.withColumn("gradient", F.round("gradient", 4) + F.lit(0.0))


@register
def linear_svc_certificate(spark, d):
    """The same of the squared hinge losses, to six digits."""
    model, rows, weight, names = fitted_linear(spark, d, "linear_svc")
    found = certificates.hinge_gradient(model, 1.0, rows, S.TARGET, weight, names)
    return found.withColumn("gradient", F.round("gradient", 6) + F.lit(0.0))


def models_on_test(spark, d, names: list[str]) -> tuple[DataFrame, dict[str, Model]]:
    """The test rows and the named models fitted on the training rows, some at a time."""
    train_rows, test_rows, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)
    train_rows = materialised(train_rows, "train")
    return materialised(test_rows, "test"), fit_classifiers(names, train_rows, S.TARGET, sizes=QUERY_SIZES)


@register
def model_reports(spark, d):
    """Classification report of every fitted model on the test rows."""
    test_rows, models = models_on_test(spark, d, MODEL_NAMES)
    return evaluate.stack([evaluate.report_on(m, test_rows).withColumn("model", F.lit(n)) for n, m in models.items()])


@register
def model_confusions(spark, d):
    """Confusion matrix of every fitted model on the test rows."""
    test_rows, models = models_on_test(spark, d, MODEL_NAMES)
    return evaluate.stack([evaluate.confusion_on(m, test_rows).withColumn("model", F.lit(n)) for n, m in models.items()])


@register
def feature_importances(spark, d):
    rows = credit_table(spark, d)
    cleaned = features.ml_pipeline(CREDIT_AS_OF).fit(rows).transform(rows)
    model = fit_classifier("random_forest", cleaned, S.TARGET, sizes=QUERY_SIZES)
    return metrics.top_importances(model, cleaned)


@register
def model_cross_validation(spark, d):
    """Every model's metrics on each of five folds."""
    train_rows, test_rows, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)
    folded = splits.stratified_folds(materialised(train_rows, "train"), 5, S.TARGET)
    return evaluate.cross_validated(MODEL_NAMES, materialised(folded, "folded"), sizes=QUERY_SIZES)


@register
def model_learning_curve(spark, d):
    train_rows, _, _ = train.prepare(credit_table(spark, d), CREDIT_AS_OF)

    def fit(rows: DataFrame):
        return fit_classifier("naive_bayes", rows, S.TARGET)

    def fit_together(rows: DataFrame, members: Column, models: int):
        return build_classifier("naive_bayes", 0, S.TARGET).fit_members(rows, members, models)

    together = (fit_together, lambda models: predicted_together(models, F.col(encoding.FEATURES)))
    curve = evaluate.learning_curve(fit, materialised(train_rows, "train"), together=together)
    # wall times differ from run to run
    return evaluate.learning_curve_summary(curve.drop("fit_seconds", "score_seconds"))


@register
def training_leaderboard(spark, d):
    """The whole job, with artifacts and ledger: eight models, each fitted on five folds and on all training rows."""
    return train.train_all(credit_table(spark, d), CREDIT_AS_OF).leaderboard


def saved_model(spark, d, name: str) -> tuple[DataFrame, str]:
    """All loans, and the folder of one classifier trained on them."""
    rows = credit_table(spark, d)
    train_rows, _, fitted = train.prepare(rows, CREDIT_AS_OF)
    model = fit_classifier(name, materialised(train_rows, "train"), S.TARGET)
    folder = scratch_path(spark, "models")
    artifacts.save_artifacts(folder, {name: model}, name, fitted)
    return rows, folder


@register
def loaded_model_scoring(spark, d):
    rows, folder = saved_model(spark, d, "linear_svc")
    _, model, fitted = artifacts.load_first(folder)
    done, _ = score.score_batch(rows, fitted, model)
    return summaries.scoring_summary(done)


@register
def loaded_model_description(spark, d):
    _, folder = saved_model(spark, d, "logistic")
    _, model, fitted = artifacts.load_first(folder)
    return artifacts.describe_model(spark, model, fitted).withColumn("stages", F.concat_ws(",", "stages"))


# --- streaming ---------------------------------------------------------------


def _scored_stream(spark: SparkSession, d: str) -> tuple[str, str]:
    rows, cleaned, model = rule_artifacts(spark, d)
    folder = scratch_path(spark, "stream")
    rows.write.json(f"{folder}/in")
    streams.start_scoring(
        streams.record_stream(spark, f"{folder}/in"), cleaned, model,
        f"{folder}/log", f"{folder}/rejected", f"{folder}/progress",
    ).awaitTermination()
    return f"{folder}/log", f"{folder}/rejected"


@register
def streamed_scoring(spark, d):
    log, _ = _scored_stream(spark, d)
    return prediction_log.read_log(spark, log).select(
        "prediction", "probability", "risk_level", *S.LOGGED_FEATURES
    )


@register
def streamed_rejections(spark, d):
    _, rejected = _scored_stream(spark, d)
    return spark.read.parquet(rejected).select(S.KEY, F.concat_ws(",", "reasons").alias("reasons"))


@register
def streamed_daily_counts(spark, d):
    folder = scratch_path(spark, "daily")
    rows = derived_log(spark, d).withColumns(
        {"id": F.col("id").cast("string"), "timestamp": F.col("timestamp").cast("timestamp")}
    )
    (
        rows.withColumn("log_date", F.to_date("timestamp"))
        .withColumn("batch", F.lit("all"))
        .write.partitionBy("log_date", "batch")
        .parquet(f"{folder}/log")
    )
    streams.start_daily_counts(
        streams.log_stream(spark, f"{folder}/log"), f"{folder}/counts", f"{folder}/progress"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("day").cast("string").alias("day"), "n")
