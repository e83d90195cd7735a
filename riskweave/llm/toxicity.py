"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary texts, compared per symbol.

Each class has counts of its own at every order, and both are smoothed by a third model of the counts of both: what a class
has not seen costs it, and what neither has seen costs both the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.kneser_ney import SCORED_BYTES, SPACE, CharModel, fit_model, row_sums, symbol_stream
from riskweave.llm.language_id import labelled_sample

ORDER = 5
#: Shares of the model of both classes that are tried; the calibration texts of both classes choose.
POOLED_SHARES = (0.005, 0.02, 0.1, 0.35, 0.7, 0.9)
#: Labelled texts of a class that the model is fitted on, about: a bounded sample by hash of the id.
TRAINING_TEXTS = 10_000
#: One in so many of them is kept from the counts and fits the decision instead.
CALIBRATION = 4
RESULTS = ("score", "predicted")
FEATURES = 3


@dataclass
class ToxicityModel:
    """Both classes' language models and a logistic decision on their differences."""

    model: CharModel
    pooled_shares: tuple[float, float]  # for whole texts, for words
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _text_and_words(*likelihood_differences(self.model, data, offsets, self.pooled_shares))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _logistic(((features - self.centre) / self.scale) @ self.weights[1:] + self.weights[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def likelihood_differences(model: CharModel, data: np.ndarray, offsets: np.ndarray, pooled_shares: Sequence[float]) -> list[np.ndarray]:
    """Of each share: toxic minus ordinary log-likelihood of each row, per symbol of the text; per symbol of its most
    toxic word; and of that word as a whole, largest over the words. Two columns more: the log-likelihoods themselves,
    ordinary first."""
    symbols, at, edges, _ = symbol_stream(data, offsets, model.order)
    rows = len(edges) - 1
    if not len(at):
        return [np.zeros((rows, FEATURES + 2)) for _ in pooled_shares]
    logs = model.position_logs(symbols, at)
    against = np.exp(logs[:, :2] - logs[:, 2:])  # of either class to the pooled model
    head = symbols[at - 1] == SPACE
    head[edges[:-1][np.diff(edges) > 0]] = True
    starts = np.flatnonzero(head)
    lengths = np.diff(np.append(starts, len(at)))
    words = np.searchsorted(starts, edges)
    filled = np.diff(words) > 0
    begin = words[:-1][filled]
    found, whole = [], row_sums(logs[:, 2:], edges)
    for share in pooled_shares:
        mixed = np.log(against * np.float32(1 - share) + np.float32(share))
        lead = mixed[:, 1].astype(np.float64) - mixed[:, 0]
        result = np.zeros((rows, FEATURES + 2))
        result[:, 0] = row_sums(lead[:, None], edges)[:, 0] / np.maximum(np.diff(edges), 1)
        result[:, FEATURES:] = row_sums(mixed, edges) + whole
        sums = np.add.reduceat(lead, starts)
        result[filled, 1] = np.maximum.reduceat(sums / lengths, begin)
        result[filled, 2] = np.maximum.reduceat(sums, begin)
        found.append(result)
    return found


def _text_and_words(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The difference of the text under one share, those of its words under another."""
    return np.column_stack([text[:, :1], words[:, 1:FEATURES]])


def _ridge(x: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-9, *[1.0] * (x.shape[1] - 1)])
    for _ in range(60):
        p = _logistic(x @ w)
        gradient = x.T @ (weight * (p - truth)) + ridge @ w
        step = np.linalg.solve(x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_decision(features: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of the decision. A likelier toxic text never scores lower: features that would get a
    negative weight are left out, one after the other."""
    centre, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
    x, used = (features - centre) / scale, list(range(features.shape[1]))
    w = _ridge(x, truth, weight)
    while used and w[1:].min() < 0:
        used.pop(int(w[1:].argmin()))
        w = _ridge(x[:, used], truth, weight)
    weights = np.zeros(1 + features.shape[1])
    weights[0], weights[[1 + k for k in used]] = w[0], w[1:]
    return centre, scale, weights


def fit_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, training: Column, id_column: str = "doc_id",
    text: str = "text", label: str = "toxic", bound: int = TRAINING_TEXTS,
) -> ToxicityModel | None:
    """The model learned from the texts whose ids ``labels`` marks 1 or 0 and ``training`` holds for.

    Whole texts of about ``bound`` ids a class are used, one in CALIBRATION of them to fit the decision, weighted so
    that the classes count as often as the labels have them, and to choose shares of the pooled model: for texts the one
    under which those of each class are likeliest to its own model, for words the one that makes the decision's loss
    least. Several labels of an id: toxic if one is. None if a class has no text with letters.
    """
    marks = labels.filter(training).filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
    marks = marks.groupBy(F.col(id_column).alias("id")).agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = labelled_sample(marks, "id", "label", bound, "toxicity")
    # about twice the bound of ids at most, so they may be broadcast
    rows = docs.select(F.col(f"`{id_column}`").alias("doc"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select(
        "label", "text", (F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION)) == 0).alias("apart")
    )
    model = fit_model(spark, rows.filter("not apart"), 2, ORDER, pooled=True)
    held = spark.sparkContext.broadcast(model)

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            for first, last in row_chunks(offsets, SCORED_BYTES):
                here = offsets[first : last + 1] - offsets[first]
                found = np.hstack(likelihood_differences(held.value, data[offsets[first] : offsets[last]], here, POOLED_SHARES))
                columns = [part.column("label").slice(first, last - first), pa.array(list(found), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "features"])

    table = rows.filter("apart").select("label", "text").mapInArrow(measured, "label int, features array<double>").toArrow()
    truth = table.column("label").to_numpy()
    if len(set(truth.tolist())) < 2:
        return None
    tried = np.array(table.column("features").to_pylist(), np.float64).reshape(len(truth), len(POOLED_SHARES), FEATURES + 2)
    own = np.stack([tried[truth == k, :, FEATURES + k].sum(axis=0) / -tried[truth == k, 0, FEATURES + k].sum() for k in (0, 1)])
    whole = int(own.sum(axis=0).argmax())
    share = np.array([totals.get(k, 0) / max(1, (truth == k).sum()) for k in (0, 1)])
    weight = share[truth] / share[truth].mean()
    fitted = []
    for i, words in enumerate(POOLED_SHARES):
        features = _text_and_words(tried[:, whole], tried[:, i])
        made = ToxicityModel(model, (POOLED_SHARES[whole], words), *_fit_decision(features, truth.astype(float), weight))
        right = np.where(truth == 1, made.scores(features), 1 - made.scores(features))
        fitted.append((-(weight * np.log(np.maximum(right, 1e-12))).sum(), i, made))
    return min(fitted, key=lambda x: x[:2])[2]


def with_toxicity(spark: SparkSession, docs: DataFrame, found: ToxicityModel | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on) of every whole text.

    Null and empty texts, and those without letters, are scored like a text whose likelihoods are equal. Without a
    model every score is 0. Rows stay as they are, repeated or not; columns named like the results are replaced; an
    empty table gives an empty result. A very long text is scored alone, in memory of about a hundred times its size.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    given = [c for c in kept if keep_text or c != text]
    out = T.StructType([docs.schema[c] for c in given]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    held = spark.sparkContext.broadcast(found)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffers(part.column(text))
            for first, last in row_chunks(offsets, SCORED_BYTES):
                score = np.zeros(last - first)
                if held.value is not None:
                    piece = offsets[first : last + 1] - offsets[first]
                    score = held.value.scores(held.value.features(data[offsets[first] : offsets[last]], piece))
                here = [part.column(c).slice(first, last - first) for c in given]
                results = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*here, *results], names=[*given, *RESULTS])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(batches, out)
