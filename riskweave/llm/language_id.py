"""Language identification: Kneser-Ney character models, least length-normalised cross-entropy, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.kneser_ney import SCORED_BYTES, CharModel, fit_model, row_sums, symbol_stream

UNKNOWN = "und"
ORDER = 4
#: Labelled texts of a language that the model is fitted on, about: a bounded sample by hash of the id.
TRAINING_TEXTS = 12_000
#: One in so many of them is kept from the counts and calibrates the decision instead.
CALIBRATION = 6
#: Share of the calibration texts of a language that are accepted, and what the limit is then widened by.
ACCEPTED = 0.999
WIDENED = 1.5
MAX_LANGUAGES = 256
RESULTS = ("lang_pred", "score", "cross_entropy", "rejected")


def labelled_sample(rows: DataFrame, key: str, label: str, bound: int, salt: str) -> DataFrame:
    """About ``bound`` rows of each label, chosen by a hash of the key; all of them where there are fewer.

    Few labels are expected: their counts come to the driver.
    """
    totals = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64(F.lit(salt), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for value, n in totals.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.filter(draw < share)


@dataclass
class LanguageModel:
    """Models of all languages with the calibration of their decision."""

    languages: list[str]
    model: CharModel
    sharpness: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # variances of a long text and of one symbol, by language
    limit: np.ndarray | None = None

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a symbol by language, symbols and letters of each row."""
        symbols, at, edges, letters = symbol_stream(data, offsets, self.model.order)
        counts = np.diff(edges)
        total = row_sums(self.model.position_logs(symbols, at), edges)
        return -total / np.maximum(counts, 1)[:, None], counts, letters

    def calibrate(self, truth: np.ndarray, entropies: np.ndarray, counts: np.ndarray) -> None:
        """Fits sharpness, means, variances and limits to texts that took no part in the counts."""
        classes = len(self.languages)
        self.mean, self.spread, self.limit = np.full(classes, np.inf), np.ones((classes, 2)), np.ones(classes)
        for k in range(classes):
            own, n = entropies[truth == k, k], counts[truth == k]
            if not len(own):
                continue
            self.mean[k] = np.median(own)
            square = (own - self.mean[k]) ** 2
            basis = np.stack([np.ones(len(own)), 1 / n], axis=1)
            self.spread[k] = np.maximum(np.linalg.lstsq(basis, square, rcond=None)[0], [1e-6, 1e-2])
            self.limit[k] = WIDENED * max(3.0, np.quantile(self._excess(own, n, k), ACCEPTED))
        if len(truth):
            losses = [(-np.log(np.maximum(self._confidence(entropies, s)[np.arange(len(truth)), truth], 1e-12)).mean(), s)
                      for s in np.geomspace(0.5, 512, 41)]
            self.sharpness = min(losses)[1]

    def _excess(self, entropy: np.ndarray, counts: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return (entropy - self.mean[k]) / np.sqrt(self.spread[k, 0] + self.spread[k, 1] / np.maximum(counts, 1))

    def _confidence(self, entropies: np.ndarray, sharpness: float) -> np.ndarray:
        lead = np.exp(-sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
        return lead / lead.sum(axis=1, keepdims=True)

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each row."""
        entropies, counts, letters = self.cross_entropies(data, offsets)
        best = entropies.argmin(axis=1)
        rows = np.arange(len(best))
        nothing = letters == 0
        score = np.where(nothing, 0.0, self._confidence(entropies, self.sharpness)[rows, best])
        least = np.where(nothing, 0.0, entropies[rows, best])
        rejected = nothing | (self._excess(entropies[rows, best], counts, best) > self.limit[best])
        return [UNKNOWN if x else self.languages[k] for x, k in zip(nothing.tolist(), best.tolist())], score, least, rejected


def fit_languages(
    spark: SparkSession, docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text",
    lang: str = "lang", bound: int = TRAINING_TEXTS, order: int = ORDER,
) -> LanguageModel | None:
    """The models learned from the rows of ``docs`` that ``training`` holds for and that have a text and a language.

    Whole texts of about ``bound`` rows a language are used, one in CALIBRATION of them for the calibration. None if
    there is no such row. More than MAX_LANGUAGES languages are refused.
    """
    rows = docs.filter(training).select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = labelled_sample(rows.filter("lang is not null and text is not null"), "id", "lang", bound, "language")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are expected")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1
    rows = rows.select(place.alias("label"), "text", (F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION)) == 0).alias("apart"))
    found = LanguageModel(names, fit_model(spark, rows.filter("not apart"), len(names), order))
    if not found.model.grams[-1].keys[:-1].size:
        return None
    held = spark.sparkContext.broadcast(found)

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffers(part.column("text"))
            labels = part.column("label")
            for first, last in row_chunks(offsets, SCORED_BYTES):
                piece = offsets[first : last + 1] - offsets[first]
                entropies, counts, letters = held.value.cross_entropies(data[offsets[first] : offsets[last]], piece)
                columns = [labels.slice(first, last - first), pa.array(list(entropies), pa.list_(pa.float64())),
                           pa.array(np.where(letters > 0, counts, 0), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "entropies", "n"])

    table = rows.filter("apart").select("label", "text").mapInArrow(measured, "label int, entropies array<double>, n bigint")
    table = table.filter("n > 0").toArrow()
    entropies = np.array(table.column("entropies").to_pylist(), np.float64).reshape(-1, len(names))
    found.calibrate(table.column("label").to_numpy(), entropies, table.column("n").to_numpy())
    return found


def with_languages(spark: SparkSession, docs: DataFrame, found: LanguageModel | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy (nats a symbol) and rejected for every whole text.

    lang_pred is the language of the least cross-entropy, ties to the first by name; ``und``, with score 0 and
    rejected, for a null text, one without letters, or if there is no model. A text is rejected too if its
    cross-entropy exceeds the calibrated limit of its language and length. Rows stay as they are, repeated or not;
    columns named like the results are replaced; an empty table gives an empty result. A very long text is scored
    alone, in memory of about a hundred times its size.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    given = [c for c in kept if keep_text or c != text]
    out = T.StructType([docs.schema[c] for c in given]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    out = out.add("cross_entropy", T.DoubleType()).add("rejected", T.BooleanType())
    held = spark.sparkContext.broadcast(found)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffers(part.column(text))
            for first, last in row_chunks(offsets, SCORED_BYTES):
                rows, piece = last - first, offsets[first : last + 1] - offsets[first]
                if held.value is None:
                    results = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.ones(rows, bool)
                else:
                    results = held.value.decide(data[offsets[first] : offsets[last]], piece)
                here = [part.column(c).slice(first, rows) for c in given]
                yield pa.RecordBatch.from_arrays([*here, *map(pa.array, results)], names=[*given, *RESULTS])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(batches, out)
