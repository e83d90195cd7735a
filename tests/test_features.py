"""Cleaning, encoding and rule stages on hand-made edges."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave import schema as S
from riskweave.functions import risk, scalars
from riskweave.operators import cleaning, encoding
from riskweave.operators.heuristic import HeuristicClassifier
from riskweave.plans.features import base_pipeline, ml_pipeline
from riskweave.session import scratch_path
from riskweave.sources.derived import CREDIT_AS_OF, credit_table


def values(df, column, key="id"):
    return {r[key]: r[column] for r in df.collect()}


def test_category_exclusion_keeps_missing(spark):
    df = spark.createDataFrame([(1, "7"), (2, None), (3, "04"), (4, "68")], "id int, tipo_credito string")
    assert set(values(cleaning.ExcludeCategories().transform(df), "tipo_credito")) == {2, 3}


def test_outlier_filter_drops_missing(spark):
    df = spark.createDataFrame([(1, 99), (2, None), (3, 100)], "id int, edad_cliente int")
    assert set(values(cleaning.KeepBelow().transform(df), "edad_cliente")) == {1}


def test_credit_age_floors_to_30_day_months(spark):
    df = spark.createDataFrame([(1, "2001-08-03"), (2, "2001-08-02"), (3, "2001-09-02"), (4, None)], "id int, d string")
    ages = values(df.withColumn("m", scalars.credit_age_months(F.to_date("d"), F.lit("2001-09-01").cast("date"))), "m")
    assert ages == {1: 0, 2: 1, 3: -1, 4: None}


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([(1, "2025-01-07"), (2, "no date"), (3, None)], "id int, d string")
    days = values(df.withColumn("t", F.to_date(scalars.parse_date(F.col("d"))).cast("string")), "t")
    assert days == {1: "2025-01-07", 2: None, 3: None}


def test_percentage_change_of_zero_base(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, 3.0, 0.0)], "id int, v double, b double")
    assert values(df.withColumn("c", scalars.pct_change(F.col("v"), F.col("b"))), "c") == {1: 50.0, 2: 0.0}


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.8, 0.79, 0.6, 0.4, 0.2, 0.19])], "id int, probability double")
    assert list(values(risk.with_risk(df), "risk_level").values()) == [
        "Bajo", "Medio-Bajo", "Medio-Bajo", "Medio", "Alto", "Muy Alto",
    ]


def test_heuristic_rules_skip_absent_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 749.9, 0), (2, 750.0, 6), (3, None, None), (4, 800.0, 7)], "id int, puntaje_datacredito double, huella_consulta int"
    )
    assert values(HeuristicClassifier().transform(df), "prediction") == {1: 0, 2: 1, 3: 1, 4: 0}
    only = df.select("id", "huella_consulta")
    renamed = HeuristicClassifier(enquiriesAbove=5.0, positive=7, negative=9).transform(only)
    assert values(renamed, "prediction") == {1: 7, 2: 9, 3: 7, 4: 9}


def test_heuristic_type_rule_compares_text_exactly(spark):
    df = spark.createDataFrame([(1, "6"), (2, "06"), (3, "68")], "id int, tipo_credito string")
    assert values(HeuristicClassifier().transform(df), "prediction") == {1: 0, 2: 1, 3: 1}


def test_scaler_uses_population_deviation_and_centres_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, c double")
    out = encoding.PopulationScaler(columns=["a", "c"]).fit(df).transform(df)
    assert values(out, "num__a") == {1: -1.0, 2: 1.0}
    assert values(out, "num__c") == {1: 0.0, 2: 0.0}


def test_training_names_the_incomplete_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError, match=r"b \(1 rows\)"):
        encoding.PopulationScaler(columns=["a", "b"], complete=True).fit(df)


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, None)], "n double, c string")
    fresh = spark.createDataFrame([(1, 1.0, "x"), (2, 1.0, "z"), (3, 1.0, None)], "id int, n double, c string")
    model = Pipeline(stages=encoding.encoding_stages(["n"], ["c"])).fit(train)
    out = model.transform(fresh)
    assert encoding.feature_names(out) == ["num__n", "cat__c_nan", "cat__c_x", "cat__c_y"]
    hot = values(out.withColumn("v", F.slice(vector_to_array("features"), 2, 3)), "v")
    assert hot == {1: [0, 1, 0], 2: [0, 0, 0], 3: [1, 0, 0]}
    without = Pipeline(stages=encoding.encoding_stages(["n"], ["c"])).fit(train.where("c is not null"))
    assert values(without.transform(fresh).withColumn("v", F.slice(vector_to_array("features"), 2, 2)), "v")[3] == [0, 0]


def test_medians_are_fitted_before_rows_are_removed(spark, sf_dir):
    rows = credit_table(spark, sf_dir)
    model = base_pipeline(CREDIT_AS_OF).fit(rows)
    expected = rows.agg(F.median("saldo_mora")).first()[0]
    assert model.stages[1].fills()["saldo_mora"] == expected


def test_saved_pipeline_gives_the_same_features(spark, sf_dir):
    rows = credit_table(spark, sf_dir)
    model = ml_pipeline(CREDIT_AS_OF).fit(rows)
    path = scratch_path(spark, "features")
    model.write().save(path)
    first = model.transform(rows).select(S.KEY, vector_to_array("features").alias("f")).orderBy(S.KEY).collect()
    again = PipelineModel.load(path).transform(rows).select(S.KEY, vector_to_array("features").alias("f"))
    assert first == again.orderBy(S.KEY).collect()


def test_stage_round_trip(spark):
    for stage in (
        cleaning.DropColumns(columns=["a"]),
        cleaning.KeepBelow(limit=50.0),
        cleaning.LoanDateFeatures(asOf="2024-01-01"),
        cleaning.AsCategory(columns=["a"]),
        cleaning.ExcludeCategories(values=["9"]),
        cleaning.MissingValueFiller(),
        HeuristicClassifier(riskyType="12"),
        encoding.FillMissingCategory(columns=["a"]),
    ):
        path = scratch_path(spark, "stage")
        stage.write().save(path)
        loaded = type(stage).load(path)
        assert {p.name: v for p, v in loaded.extractParamMap().items()} == {
            p.name: v for p, v in stage.extractParamMap().items()
        }
