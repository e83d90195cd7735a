"""Streams against their batch counterparts."""

from pyspark.sql import functions as F

from riskweave import schema as S
from riskweave.operators import summaries
from riskweave.operators.heuristic import HeuristicClassifier
from riskweave.plans.features import base_pipeline
from riskweave.session import scratch_path
from riskweave.sources.derived import CREDIT_AS_OF, credit_table, prediction_log
from riskweave.sources.prediction_log import read_log
from riskweave.streaming import scoring as streams
from pyspark.ml import PipelineModel


def test_records_arriving_in_two_runs_are_scored_once(spark, sf_dir):
    rows = credit_table(spark, sf_dir)
    features = base_pipeline(CREDIT_AS_OF).fit(rows)
    model = PipelineModel(stages=[HeuristicClassifier()])
    folder = scratch_path(spark, "stream")

    def run():
        records = streams.record_stream(spark, f"{folder}/in", files_per_batch=1)
        streams.start_scoring(
            records, features, model, f"{folder}/log", f"{folder}/rejected", f"{folder}/progress"
        ).awaitTermination()

    for part in (0, 1):
        rows.where(F.col(S.KEY) % 2 == part).coalesce(1).write.mode("append").json(f"{folder}/in")
        run()
    run()  # nothing new
    log, rejected = read_log(spark, f"{folder}/log"), spark.read.parquet(f"{folder}/rejected")
    assert log.count() + rejected.count() == rows.count()
    assert log.select("id").distinct().count() == log.count()
    assert rejected.where(F.size("reasons") == 0).count() == 0
    assert log.select("batch").distinct().count() == 2


def test_daily_counts_follow_late_arrivals(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumns(
        {"id": F.col("id").cast("string"), "timestamp": F.col("timestamp").cast("timestamp")}
    )
    folder = scratch_path(spark, "daily")

    def arrive(rows, batch):
        rows.withColumn("log_date", F.to_date("timestamp")).withColumn("batch", F.lit(batch)).coalesce(1).write.mode(
            "append"
        ).partitionBy("log_date", "batch").parquet(f"{folder}/log")
        streams.start_daily_counts(
            streams.log_stream(spark, f"{folder}/log"), f"{folder}/counts", f"{folder}/progress"
        ).awaitTermination()

    arrive(log.where("timestamp < '2024-01-10'"), "one")
    arrive(log.where("timestamp >= '2024-01-10'"), "two")
    streamed = {r["day"]: r["n"] for r in spark.read.parquet(f"{folder}/counts").collect()}
    assert streamed == {r["day"]: r["n"] for r in summaries.daily_counts(log).collect()}


def test_a_row_many_days_late_is_counted(spark):
    folder = scratch_path(spark, "late")

    def arrive(days, batch):
        rows = spark.createDataFrame([(str(i), f"{day} 10:00:00") for i, day in enumerate(days)], "id string, at string")
        rows = rows.select("id", F.col("at").cast("timestamp").alias("timestamp"))
        rows.withColumn("log_date", F.to_date("timestamp")).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy(
            "log_date", "batch"
        ).parquet(f"{folder}/log")
        streams.start_daily_counts(streams.log_stream(spark, f"{folder}/log"), f"{folder}/counts", f"{folder}/progress").awaitTermination()
        return {str(r["day"]): r["n"] for r in spark.read.parquet(f"{folder}/counts").collect()}

    arrive(["2024-01-01", "2024-01-10"], "one")
    assert arrive(["2024-01-02"] * 7 + ["2024-01-10"], "two") == {"2024-01-01": 1, "2024-01-02": 7, "2024-01-10": 2}
    assert arrive(["2024-01-01"], "three")["2024-01-01"] == 2


def test_a_batch_replayed_on_another_day_leaves_the_same_rows(spark, sf_dir, monkeypatch):
    """The time comes with the batch, so that the handler's own clock does not matter."""
    rows = credit_table(spark, sf_dir).limit(200)
    features = base_pipeline(CREDIT_AS_OF).fit(rows)
    handlers = []

    class Recorder:
        def __getattr__(self, name):
            return lambda *args, **kwargs: (handlers.append(args[0]) if name == "foreachBatch" else None, self)[1]

    class Records:
        def withColumn(self, name, value):
            assert name == "timestamp"
            self.writeStream = Recorder()
            return self

    folder = scratch_path(spark, "replay")
    streams.start_scoring(Records(), features, PipelineModel(stages=[HeuristicClassifier()]), f"{folder}/log", f"{folder}/rejected", f"{folder}/progress")
    batch = rows.withColumn("timestamp", F.lit("2024-03-01 23:59:59").cast("timestamp"))
    handlers[0](batch, 0)
    first = sorted(read_log(spark, f"{folder}/log").collect())
    handlers[0](batch, 0)
    assert sorted(read_log(spark, f"{folder}/log").collect()) == first and first
    assert {str(r["log_date"]) for r in first} == {"2024-03-01"}
