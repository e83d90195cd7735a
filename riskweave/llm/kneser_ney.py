"""Class-conditional Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.flat import U64, SortedHashes, mix, row_chunks, text_buffers
from riskweave.llm.scratch import saved

SPACE = 32
#: Rows whose n-gram counts a task holds before it hands them on.
HELD_GRAMS = 2_000_000
#: Bytes of text that are scored at a time, but for a longer text: what scoring holds is about a hundred times that.
SCORED_BYTES = 1 << 19

_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(16)]


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: the lower-case letter, or a space for whatever is no letter."""
    table = np.full(0x110000, SPACE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def symbol_stream(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, predicted positions, first prediction of each row (rows + 1), letters of each row) of UTF-8 rows.

    Runs of other characters become one space, leading ones vanish, a row with letters ends in one space. Each row
    starts after ``order - 1`` spaces, so that no n-gram crosses rows.
    """
    rows = len(offsets) - 1
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    symbols = symbol_table()[codes]
    letter = symbols != SPACE
    letters = np.add.reduceat(np.append(letter, False), chars[:-1]) * (np.diff(chars) > 0) if rows else np.zeros(0, np.int64)
    # a space is kept after a letter of its row; a last letter gets one
    follows = np.zeros(len(symbols), bool)
    if len(symbols):
        follows[1:] = letter[:-1]
        heads = chars[:-1][np.diff(chars) > 0]
        follows[heads] = False
    keep = letter | follows
    symbols = symbols[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])[chars]
    lengths = np.diff(kept)
    closing = np.zeros(rows, bool)
    filled = lengths > 0
    if len(symbols):
        closing[filled] = symbols[kept[1:][filled] - 1] != SPACE
    first = np.concatenate([[0], np.cumsum(lengths + closing)])
    row = np.repeat(np.arange(rows), lengths)
    place = np.arange(len(symbols)) - kept[row] + first[row] + (row + 1) * (order - 1)
    stream = np.full(first[-1] + rows * (order - 1), SPACE, np.uint32)
    stream[place] = symbols
    at = np.arange(first[-1]) + (np.repeat(np.arange(rows), np.diff(first)) + 1) * (order - 1)
    return stream, at, first, letters


def _raw_hash(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(at), U64)
    for k in range(length):
        total += (symbols[at - k].astype(U64) + U64(1)) * U64(_POWERS[k])
    return total


def _key(raw: np.ndarray, length: int) -> np.ndarray:
    return mix(raw + U64(length * 0x2545F4914F6CDD1D % (1 << 64)))


def _code_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of n-grams given as rows of code points."""
    length = codes.shape[1]
    total = np.zeros(len(codes), U64)
    for k in range(length):
        total += (codes[:, length - 1 - k].astype(U64) + U64(1)) * U64(_POWERS[k])
    return _key(total, length)


def _grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys of the distinct rows, the rows in that order, and the place of each given row among them."""
    keys, index, inverse = np.unique(_code_keys(codes), return_index=True, return_inverse=True)
    return keys, codes[index], inverse.ravel()


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(label, gram, n): how often each n-gram of ``order`` symbols occurs in the texts of each label.

    ``rows``: label int, text. Counts are gathered per task before the shuffle.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hashes, codes, counts = (np.concatenate(x) for x in zip(*held[label]))
            found, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            return found, codes[index], np.bincount(inverse, weights=counts).astype(np.int64)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for label in held:
                _, codes, counts = merged(label)
                grams = np.ascontiguousarray(codes).view(f"<U{order}").ravel()
                for a in range(0, len(grams), 100_000):
                    piece = grams[a : a + 100_000]
                    columns = [pa.array(np.full(len(piece), label, np.int32)), pa.array(piece.tolist(), pa.string()),
                               pa.array(counts[a : a + 100_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "gram", "n"])

        for part in parts:
            labels = part.column("label").to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(part.column("text"))
            for first, last in row_chunks(offsets):
                piece = data[offsets[first] : offsets[last]]
                symbols, at, edges, _ = symbol_stream(piece, offsets[first : last + 1] - offsets[first], order)
                hashes, of = _raw_hash(symbols, at, order), np.repeat(labels[first:last], np.diff(edges))
                for label in np.unique(of).tolist():
                    mine = np.flatnonzero(of == label)
                    found, index, counts = np.unique(hashes[mine], return_index=True, return_counts=True)
                    where = at[mine[index]]
                    codes = np.stack([symbols[where - k] for k in range(order - 1, -1, -1)], axis=1)
                    held.setdefault(label, []).append((found, codes, counts))
                    size += len(found)
            if size > HELD_GRAMS:
                for label in held:
                    held[label] = [merged(label)]
                size = sum(len(x[0][0]) for x in held.values())
                if size > HELD_GRAMS // 2:
                    yield from handed_on()
                    held, size = {}, 0
        yield from handed_on()

    partial = rows.select("label", "text").mapInArrow(batches, "label int, gram string, n bigint")
    return partial.groupBy("label", "gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated Kneser-Ney probabilities of every class, looked up by n-gram hash.

    Orders from ``own_from`` on have counts of each class; lower ones are shared by all classes. With ``pooled`` one more
    column follows those of the classes: the model of the counts of all classes together.
    """

    def __init__(
        self, grams: list[str] | pa.ChunkedArray, labels: np.ndarray, counts: np.ndarray, classes: int, order: int, own_from: int = 1,
        pooled: bool = False,
    ):
        data, _ = text_buffers(pa.array(grams, pa.string()) if isinstance(grams, list) else grams)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).reshape(-1, order)
        keys, codes, of = _grouped(codes)
        table = np.zeros((len(codes), classes))
        np.add.at(table, (of, labels), counts)
        if pooled:
            table, classes = np.column_stack([table, table.sum(axis=1)]), classes + 1
        self.order, self.classes = order, classes
        self.floor = -np.log(len(np.unique(codes)) + 2.0)
        levels = []  # keys, counts by class, codes of the contexts, place of the shorter n-gram; longest first
        for length in range(order, 0, -1):
            shorter, lower, up = _grouped(codes[:, 1:])
            levels.append((keys, table, codes[:, :-1], up))
            kinds = np.zeros((len(lower), classes))
            np.add.at(kinds, up, (table > 0).astype(float) if length - 1 >= own_from else np.ones((len(codes), classes)))
            keys, codes, table = shorter, lower, kinds
        below = np.full((1, classes), np.exp(self.floor))
        self.grams: list[SortedHashes] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[SortedHashes] = []
        self.weights: list[np.ndarray] = []
        for keys, seen, before, up in reversed(levels):
            ones, twos = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
            discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
            contexts, before, of = _grouped(before)
            total, kinds = np.zeros((len(contexts), classes)), np.zeros((len(contexts), classes))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, (seen > 0).astype(float))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = np.maximum(seen - discount, 0) / np.maximum(total[of], 1) + weight[of] * below[up]
            self.grams.append(SortedHashes(keys))
            self.logs.append(np.log(below).astype(np.float32))
            self.contexts.append(SortedHashes(contexts))
            self.weights.append(np.log(weight).astype(np.float32))

    def position_logs(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of the symbol at each position, by class."""
        result = np.zeros((len(at), self.classes), np.float32)
        raws = [np.zeros(len(at), U64)]
        for k in range(self.order):
            raws.append(raws[-1] + (symbols[at - k].astype(U64) + U64(1)) * U64(_POWERS[k]))
        left = np.arange(len(at))
        for length in range(self.order, 0, -1):
            found = self.grams[length - 1].find(_key(raws[length][left], length))
            hit = found >= 0
            result[left[hit]] += self.logs[length - 1][found[hit]]
            left = left[~hit]
            if not len(left):
                return result
            before = self.contexts[length - 1].find(_key(_raw_hash(symbols, at[left] - 1, length - 1), length - 1))
            known = before >= 0
            result[left[known]] += self.weights[length - 1][before[known]]
        result[left] += np.float32(self.floor)
        return result


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values`` between ``edges``; empty ranges give zero."""
    total = np.zeros((len(edges) - 1, values.shape[1]))
    filled = np.diff(edges) > 0
    if filled.any():
        total[filled] = np.add.reduceat(values, edges[:-1][filled], axis=0, dtype=np.float64)
    return total


def fit_model(spark: SparkSession, rows: DataFrame, classes: int, order: int, own_from: int = 1, pooled: bool = False) -> CharModel:
    """The model of ``rows`` (label, text), a sample of bounded size. All its n-grams reach the driver, none is cut off."""
    table = saved(spark, gram_counts(rows, order), "grams").toArrow()
    labels, counts = (table.column(c).to_numpy() for c in ("label", "n"))
    return CharModel(table.column("gram"), labels, counts, classes, order, own_from, pooled)
