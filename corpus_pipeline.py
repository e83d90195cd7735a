"""Corpus preparation: language, repeated lines, near-duplicates, benchmark passages, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, language_id
from riskweave.llm.bpe import token_digests, with_token_ids
from riskweave.llm.line_dedup import lines_removed
from riskweave.llm.scratch import fresh_name, saved
from riskweave.llm.simhash import near_duplicates_removed


def _aside(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns named like a result renamed, and what gives back the columns of ``docs``."""
    names = {}
    for column in docs.columns:
        names[column] = fresh_name(docs, f"{column}_given") if column.lower() in results else column
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda df: df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language model accepts them; models are learned from the labelled ones of the input."""
    found = language_id.fit_languages(spark, docs, F.lit(True))
    given, restored = _aside(docs, language_id.RESULTS)
    return restored(language_id.with_languages(spark, given, found).filter("not rejected"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, and with n_chars of what is left."""
    return _measured(lines_removed(spark, docs, percent=80))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_duplicates_removed(spark, docs, width=4, distance=4)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    given, restored = _aside(docs, decontaminate.RESULTS)
    hits = decontaminate.benchmark_hits(spark, given, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    return restored(decontaminate.without_contaminated(hits))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return token_digests(with_token_ids(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: None: language models and their calibration are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each one's result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
