"""Session construction and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the cluster.

    Only a local master, where there is one machine, may leave it unset: then a folder beside its tables is used.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Paths handed out by ``scratch_path`` and not cleared yet.
_handed_out: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared folder and read back: computed once, safe from lost executors, not held in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``scratch_path`` handed out and nothing reads any more."""
    if path in _handed_out:
        _handed_out.remove(path)
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this program has written under the shared folder; no result read from there may be used again."""
    while _handed_out:
        path = spark._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
