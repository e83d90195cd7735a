"""Readers, validation, snapshots and the prediction log."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from riskweave import schema as S
from riskweave.operators import drift, summaries, validation
from riskweave.plans.score import split_excluded
from riskweave.session import scratch_path
from riskweave.sources import credit, prediction_log
from riskweave.sources.derived import credit_table

SAMPLE = {
    "tipo_credito": "12", "fecha_prestamo": "2023-11-20", "capital_prestado": 940000.5, "plazo_meses": 36,
    "edad_cliente": 51, "tipo_laboral": "Independiente", "salario_cliente": 2100000, "total_otros_prestamos": 350000,
    "cuota_pactada": 41000, "puntaje": 60.5, "puntaje_datacredito": 702.0, "cant_creditosvigentes": 3,
    "huella_consulta": 1, "saldo_mora": 10.0, "saldo_total": 250.0, "saldo_principal": 200.0, "saldo_mora_codeudor": 0.0,
    "creditos_sectorFinanciero": 2, "creditos_sectorCooperativo": 1, "creditos_sectorReal": 1,
    "promedio_ingresos_datacredito": 1800000.0, "tendencia_ingresos": "Decreciente",
}


def violations(spark, **changes):
    record = {k: v for k, v in {**SAMPLE, **changes}.items() if v is not None}
    return validation.with_violations(credit.read_records(spark, [record])).first()["violations"]


def test_sample_record_is_valid(spark):
    assert violations(spark) == []


@pytest.mark.parametrize(
    "change, broken",
    [
        ({"plazo_meses": 0}, ["min::plazo_meses"]),
        ({"plazo_meses": 121}, ["max::plazo_meses"]),
        ({"edad_cliente": 17}, ["min::edad_cliente"]),
        ({"edad_cliente": 100, "saldo_mora": -1}, ["max::edad_cliente", "min::saldo_mora"]),
        ({"plazo_meses": 12.5}, ["type::plazo_meses"]),
        ({"plazo_meses": 12.0}, []),
        ({"salario_cliente": "much"}, ["type::salario_cliente"]),
        ({"salario_cliente": "NaN"}, []),
        ({"fecha_prestamo": "someday"}, []),
        ({"edad_cliente": None, "salario_cliente": None}, []),
        ({"puntaje": -5}, []),
    ],
)
def test_record_rules(spark, change, broken):
    assert violations(spark, **change) == broken


def test_records_with_different_keys_and_broken_lines(spark):
    folder = scratch_path(spark, "json")
    lines = ['{"loan_id": 1, "edad_cliente": 30}', '{"loan_id": 2, "puntaje": 1.5}', "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(folder)
    valid, rejected = validation.split_valid(credit.read_record_files(spark, folder))
    assert {r[S.KEY]: (r["edad_cliente"], r["puntaje"]) for r in valid.collect()} == {1: (30, None), 2: (None, 1.5)}
    assert [r["violations"] for r in rejected.collect()] == [["type::record"]]


def test_scoring_file_must_be_csv(spark):
    with pytest.raises(ValueError):
        credit.read_scoring_file(spark, "/data/loans.txt")


def test_load_credit_from_csv_and_parquet(spark, sf_dir):
    rows = credit_table(spark, sf_dir).withColumn("fecha_prestamo", F.col("fecha_prestamo").cast("timestamp"))
    base = scratch_path(spark, "credit")
    rows.write.parquet(base)
    rows.write.option("header", True).csv(base + ".csv")
    parquet = credit.load_credit(spark, base)
    text = credit.load_credit(spark, base + ".csv")
    assert parquet.select(sorted(parquet.columns)).exceptAll(text.select(sorted(parquet.columns))).count() == 0
    assert parquet.count() == text.count() == rows.count()


def test_snapshot_is_used_only_when_wanted(spark):
    path = scratch_path(spark, "snapshot")
    read = lambda n: lambda: spark.range(n)
    assert credit.load_with_snapshot(spark, read(3), path, use_snapshot=True).count() == 3
    assert credit.load_with_snapshot(spark, read(5), path, use_snapshot=True).count() == 3
    assert credit.load_with_snapshot(spark, read(5), path).count() == 5


def test_required_columns_are_checked(spark):
    df = credit.read_records(spark, [SAMPLE]).drop("salario_cliente")
    results = validation.check_results(df)
    failing = {r["check"]: r["message"] for r in validation.failing_checks(results).collect()}
    assert failing == {"required::salario_cliente": "salario_cliente MISSING"}
    with pytest.raises(ValueError, match="salario_cliente"):
        split_excluded(df)


def test_exclusion_reasons(spark):
    records = [
        {**SAMPLE, "loan_id": 1},
        {**SAMPLE, "loan_id": 2, "edad_cliente": None, "tipo_credito": "7"},
        {**SAMPLE, "loan_id": 3, "fecha_prestamo": "x", "salario_cliente": None},
        {**SAMPLE, "loan_id": 4, "tipo_credito": None, "tipo_laboral": None},
    ]
    usable, excluded = split_excluded(credit.read_records(spark, records))
    assert {r[S.KEY] for r in usable.collect()} == {1, 4}
    assert {r[S.KEY]: r["excluded_because"] for r in excluded.collect()} == {
        2: ["age", "credit_type"],
        3: ["missing::fecha_prestamo", "missing::salario_cliente"],
    }


def test_a_batch_without_a_time_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0.5)], f"{S.KEY} long, prediction int, probability double")
    with pytest.raises(ValueError):
        prediction_log.append_predictions(rows, str(tmp_path / "log"), "one")
    timed = rows.withColumn("timestamp", F.lit("2024-05-01 10:00:00"))
    for _ in range(2):
        prediction_log.append_predictions(timed, str(tmp_path / "log"), "one")
    assert prediction_log.read_log(spark, str(tmp_path / "log")).count() == 1


def test_log_defaults_and_repeated_batches(spark):
    location = scratch_path(spark, "log")
    rows = credit.read_records(spark, [{**SAMPLE, "loan_id": i} for i in range(3)]).drop(validation.BROKEN)
    for batch in ("a", "a", "b"):
        prediction_log.append_predictions(rows, location, batch, "2024-05-01 10:00:00")
    log = prediction_log.read_log(spark, location)
    assert log.count() == 6
    row = log.first()
    assert (row["prediction"], row["probability"], row["risk_level"]) == (0, 0.5, "Unknown")
    assert row["timestamp"] == datetime.datetime(2024, 5, 1, 10) or row["timestamp"].year == 2024
    assert F is not None and "tipo_credito" in row["input_data"]
    recent = prediction_log.recent_log(log, 1, "2024-05-01 12:00:00")
    assert recent.count() == 6
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_window_is_half_open(spark):
    times = ["2024-01-01 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00"]
    log = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, t string").select(
        "id", F.to_timestamp("t").alias("timestamp")
    )
    assert [r["id"] for r in prediction_log.newest_first(log, 7, "2024-01-08 00:00:00").collect()] == [1, 0]


def drift_log(spark, recent, older):
    rows = [(f"2024-01-30 00:00:{i:02d}", v) for i, v in enumerate(recent)]
    rows += [(f"2024-01-20 00:00:{i:02d}", v) for i, v in enumerate(older)]
    return spark.createDataFrame(rows, "t string, v double").select(
        F.to_timestamp("t").alias("timestamp"), F.col("v").alias("capital_prestado")
    )


AS_OF = "2024-01-31 00:00:00"


@pytest.mark.parametrize(
    "recent, older, status, rows",
    [
        ([1.0] * 4, [1.0] * 9, "insufficient_data", 0),
        ([1.0] * 9, [1.0] * 4, "insufficient_data", 0),
        ([1.0, 1.0, None, None, None], [1.0] * 9, "ok", 0),
        ([1.0] * 5, [1.0] * 5, "ok", 1),
    ],
)
def test_drift_guards(spark, recent, older, status, rows):
    log = drift_log(spark, recent, older)
    assert drift.drift_status(log, AS_OF).first()["status"] == status
    assert drift.drift_by_feature(log, AS_OF).count() == rows


@pytest.mark.parametrize(
    "recent, older, p, drifted",
    [
        ([2.0] * 5, [2.0] * 5, None, False),
        ([2.0] * 5, [2.1] * 5, 0.0, True),
        ([1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 0.0, 0.0, 0.0, 0.0], pytest.approx(0.00283, abs=2e-5), True),
    ],
)
def test_drift_without_variance_or_base(spark, recent, older, p, drifted):
    row = drift.drift_by_feature(drift_log(spark, recent, older), AS_OF).first()
    assert row["p_value"] == p and row["drift_detected"] is drifted
    if older[0] == 0:
        assert row["change_pct"] == 0


def test_empty_log_summary(spark):
    log = drift_log(spark, [1.0], []).where("false").withColumns(
        {"risk_level": F.lit("Bajo"), "prediction": F.lit(1), "probability": F.lit(0.5), "puntaje_datacredito": F.lit(1.0)}
    )
    row = summaries.log_summary(log).first()
    assert row["status"] == "no_data" and row["total_predictions"] == 0 and row["approval_rate"] is None


def test_empty_batch_has_null_percentages(spark):
    empty = spark.createDataFrame([], "prediction int, probability double, risk_level string, risk_score double, recommendation string")
    row = summaries.scoring_summary(empty).first()
    assert row["total_predictions"] == 0 and row["payer_pct"] is None


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    log = spark.createDataFrame([(float(v),) for v in range(16)], "capital_prestado double")
    bins = {r["bucket"]: r["n"] for r in summaries.amount_histogram(log).collect()}
    assert bins[15] == 2 and sum(bins.values()) == 16 and max(bins) == 15
    constant = spark.createDataFrame([(3.0,), (3.0,)], "capital_prestado double")
    assert [(r["bucket"], r["n"]) for r in summaries.amount_histogram(constant).collect()] == [(1, 2)]


def test_shared_dir_is_the_clusters(spark):
    from riskweave.session import shared_dir

    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())
    assert os.path.basename(scratch_path(spark, "x")).startswith("x-")
