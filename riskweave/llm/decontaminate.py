"""Benchmark decontamination: a broadcast hash set of test windows against the windows of every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.flat import LOWER, U64, SortedHashes, mix, row_chunks, span_hashes, text_buffers, word_spans
from riskweave.llm.scratch import saved

#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark takes several passes.
BROADCAST_BYTES = 4 << 20

SEPARATORS = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
RESULTS = ("n_words", "n_hit", "hit_spans", "item_ids")
SPANS = T.ArrayType(T.StructType().add("first", T.LongType(), False).add("last", T.LongType(), False), False)


def normalised_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and non-ASCII characters after lowering A-Z."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` word hashes from each position on."""
    total = np.zeros(max(0, len(words) - length + 1), U64)
    if not len(total):
        return total
    for k in range(length):
        total *= U64(0x9FB21C651E98DF25)
        total += words[k : len(words) - length + 1 + k]
    return mix(total)


class Windows:
    """The benchmark's windows by length: hashes to search, and words and items to verify."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.items: dict[bytes, set[int]] = {}
        by_length: dict[int, set[bytes]] = {}
        for item, text in items:
            words = normalised_words(text)
            length = min(width, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                window = b" ".join(words[i : i + length])
                self.items.setdefault(window, set()).add(item)
                by_length.setdefault(length, set()).add(window)
        self.hashes = {}
        for length, windows in by_length.items():
            found = []
            for window in windows:
                data = np.frombuffer(window, np.uint8)
                starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
                found.append(_window_hashes(span_hashes(data, starts, ends), length))
            self.hashes[length] = SortedHashes(np.unique(np.concatenate(found)))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of rows of lower-case bytes: word starts and ends, first words of the rows, hit words, (row, item) hits."""
        starts, ends, heads = word_spans(data, offsets, SEPARATORS)
        change = np.zeros(len(starts) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        if not self.hashes or not len(starts):
            return starts, ends, heads, change[:-1] > 0, items
        hashes, raw = span_hashes(data, starts, ends), data.tobytes()
        row = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        for length, known in self.hashes.items():
            at = np.flatnonzero(known.find(_window_hashes(hashes, length)) >= 0)
            for i in at[row[at] == row[at + length - 1]].tolist():
                window = b" ".join([raw[a:b] for a, b in zip(starts[i : i + length].tolist(), ends[i : i + length].tolist())])
                if window in self.items:
                    change[i] += 1
                    change[i + length] -= 1
                    items[row[i]] |= self.items[window]
        return starts, ends, heads, np.cumsum(change[:-1]) > 0, items


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _benchmark_parts(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in groups of at most ``limit`` bytes (or one item), each small enough to broadcast."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).na.drop()
    parts = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit
    for k in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        group, size = [], 0
        for row in mine.toLocalIterator():
            body = row["text"].encode()
            if group and size + len(body) > limit:
                yield group
                group, size = [], 0
            group.append((row["item"], body))
            size += len(body)
        yield group


def benchmark_hits(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, keep_text: bool = True,
    text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (runs of hit words, from ``first`` up to but not including ``last``) and
    item_ids (items with occurring windows, ascending).

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
    runs of digits, letters and non-ASCII characters, A-Z lowered. Each candidate found by hash is verified by its
    words. Windows are broadcast for at most ``limit`` bytes of benchmark text at a time; a larger benchmark takes
    several passes, each adding its hits to the written result of the one before. Null and empty texts have no words;
    items with a null id or text take no part; rows stay as they are, repeated or not; columns of ``docs`` named like
    the results are replaced; empty tables give empty results or no hits. A very long text is scanned alone, in
    memory of about thirty times its size.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
        "hit_spans": F.array().cast(SPANS), "item_ids": F.array().cast("array<bigint>"),
    })
    groups = _benchmark_parts(benchmark, item, item_text, limit)
    group = next(groups)
    while group is not None:
        following = next(groups, None)
        docs = _scanned(spark, docs, group, width, text, kept)
        if following is not None:
            docs = saved(spark, docs, "decontamination")
        group = following
    return docs if keep_text else docs.drop(text)


def _scanned(
    spark: SparkSession, docs: DataFrame, group: list[tuple[int, bytes]], width: int, text: str, kept: list[str]
) -> DataFrame:
    held = spark.sparkContext.broadcast(Windows(group, width))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for part in parts:
            data, offsets = text_buffers(part.column(text))
            for first, last in row_chunks(offsets):
                here = part.slice(first, last - first)
                low = LOWER[data[offsets[first] : offsets[last]]]
                _, _, heads, hit, items = windows.scan(low, offsets[first : last + 1] - offsets[first])
                spans, counts = [], []
                for k, (a, b) in enumerate(zip(heads.tolist(), heads[1:].tolist())):
                    earlier = here.column("hit_spans")[k].as_py()
                    mine = hit[a:b]
                    if earlier:
                        mine = mine.copy()
                        for span in earlier:
                            mine[span["first"] : span["last"]] = True
                        items[k] |= set(here.column("item_ids")[k].as_py())
                    counts.append(int(mine.sum()))
                    spans.append([{"first": x, "last": y} for x, y in zip(*(e.tolist() for e in _runs(mine)))] if counts[-1] else [])
                results = [
                    pa.array(np.diff(heads), pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in kept], *results], names=[*kept, *RESULTS])

    return docs.mapInArrow(batches, docs.schema)


def without_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``benchmark_hits`` with the hit runs cut from the text, and without the result columns.

    Each run goes from the first byte of its first word to the last byte of its last word. Null texts stay null.
    """
    kept = [c for c in hits.columns if c not in RESULTS]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(text).to_pylist()
            for k, spans in enumerate(part.column("hit_spans").to_pylist()):
                if spans:
                    raw = texts[k].encode()
                    low = LOWER[np.frombuffer(raw, np.uint8)]
                    starts, ends, _ = word_spans(low, np.array([0, len(low)]), SEPARATORS)
                    edges = [0, *[x for s in spans for x in (int(starts[s["first"]]), int(ends[s["last"] - 1]))], len(raw)]
                    texts[k] = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])]).decode()
            columns = [pa.array(texts, pa.string()) if c == text else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return hits.mapInArrow(batches, hits.select(*[F.col(f"`{c}`") for c in kept]).schema)


def without_contaminated(hits: DataFrame) -> DataFrame:
    """The rows of ``benchmark_hits`` without a hit, and without the result columns."""
    return hits.filter("n_hit = 0").drop(*RESULTS)
