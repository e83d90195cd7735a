"""SimHash near-duplicates: fingerprints of word shingles, pigeonring candidates, exact Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.flat import row_chunks, text_buffers
from riskweave.llm.graph import components
from riskweave.llm.scratch import fresh_name, saved

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
#: A chain key with more fingerprints than this links them by midpoints instead of pairs.
CROWD = 2000


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of the whole text: a bit is set if set in over half the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(word) + 1 for word in words], out=edges[1:])
    starts = edges[:shingles].tolist()
    ends = (edges[min(width, len(words)) :][:shingles] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, shingles, SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])
        raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, name: str, width: int, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long column ``name``."""
    kept = [column for column in docs.columns if column != text]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias(name)).schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data, offsets = text_buffers(part.column(text))
            values = []
            for first, last in row_chunks(offsets):
                values += [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), width) for i in range(first, last)]
            columns = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], names=[*kept, name])

    return docs.mapInArrow(batches, out)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments of the fingerprint, in ring order."""
    edges = [round(BITS * k / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _chain_keys(value: Column, ring: list[tuple[int, int]], start: int, flips: bool) -> list[Column]:
    """Hash of the chain's start, its first and its second segment; with ``flips`` also for each bit that the second
    one may differ in. Equal hashes of different chains cost a check and no more."""
    (a, n), (b, m) = ring[start], ring[(start + 1) % len(ring)]
    head, second = _segment(value, a, n), _segment(value, b, m)
    masks = [0, *[1 << j for j in range(m)]] if flips else [0]
    return [F.xxhash64(F.lit(start), head, second.bitwiseXOR(F.lit(mask).cast("long"))) for mask in masks]


def _asked_keys(value: Column, ring: list[tuple[int, int]]) -> Column:
    return F.array(*[key for start in range(len(ring)) for key in _chain_keys(value, ring, start, True)])


def _chain_holds(x: Column, ring: list[tuple[int, int]], start: int, distance: int) -> Column:
    """Cumulative differences of the chain from ``start`` stay within the proportional budgets, link after link."""
    size, total, holds = len(ring), F.lit(0), F.lit(True)
    for length in range(1, size + 1):
        total = total + F.bit_count(_segment(x, *ring[(start + length - 1) % size]))
        holds = holds & (total <= length * distance // size)
    return holds


def _linked_pairs(nodes: DataFrame, keys: DataFrame, ring: list[tuple[int, int]], distance: int) -> DataFrame:
    """Pairs (u, v) of fingerprints within ``distance``, by chains that start in equal segments.

    ``keys`` are the (key, start, fp) rows of the chains that may be joined. The second link of a chain differs in at
    most one bit, so the other side asks for its segment and each one-bit neighbour of it.
    """
    right = nodes.select(F.col("fp").alias("v"), F.explode(_asked_keys(F.col("fp"), ring)).alias("asked"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    chain = F.lit(False)
    for start in range(len(ring)):
        chain = chain | ((F.col("start") == start) & _chain_holds(x, ring, start, distance))
    # Spark sizes an explode like its input and would broadcast dozens of rows a fingerprint
    left = keys.select("key", "start", F.col("fp").alias("u"))
    return left.join(
        right.hint("merge"),
        (F.col("key") == F.col("asked")) & (F.col("u") < F.col("v")) & chain & (F.bit_count(x) <= distance),
    ).select("u", "v")


def _midpoint_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Links of equal connectivity for crowded keys, without pairs.

    Two fingerprints are within ``distance`` exactly if some value lies within half of it (rounded up and down) of
    either. Each fingerprint is sent to the values around it, and all that meet at a value are linked to the least
    of them. Meeting fingerprints may be up to twice the rounded-up half apart, so an odd distance rounds down on
    one side: ``u`` comes with the lower half, ``v`` with the upper, and a star needs a member of the lower half.
    """
    lower, upper = distance // 2, distance - distance // 2
    values = {0}
    for _ in range(upper):
        values |= {value ^ (1 << j) for value in values for j in range(BITS)}
    masks = ",".join(f"{value - (1 << 64) if value >> 63 else value}L" for value in sorted(values) if value != 1 << 63)
    sent = crowded.select("fp").distinct().select(
        "fp", F.explode(F.concat(F.expr(f"array({masks})"), F.array(F.shiftleft(F.lit(1).cast("long"), 63)))).alias("mask")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), (F.bit_count("mask") <= lower).alias("low"))
    hubs = sent.groupBy("at").agg(F.min(F.when(F.col("low"), F.col("fp"))).alias("u"), F.count(F.lit(1)).alias("n"))
    return (
        sent.join(hubs.filter("n > 1 and u is not null").hint("merge"), "at").select("u", F.col("fp").alias("v"))
        .filter("u != v").distinct()
    )


def near_links(spark: SparkSession, nodes: DataFrame, distance: int, crowd: int = CROWD) -> DataFrame:
    """(u, v) links whose components are those of all pairs of ``nodes.fp`` that differ in at most ``distance`` bits.

    Keys that hold up to ``crowd`` fingerprints are joined in pairs, each pair passing the pigeonring chain and then
    the full Hamming check. Fingerprints of more crowded keys are linked through midpoints, whose number is linear;
    there every pair within the distance shares a midpoint with a star, and every star joins only pairs that do.
    """
    ring = _segments(distance)
    keyed = nodes.select(
        "fp",
        F.posexplode(F.array(*[_chain_keys(F.col("fp"), ring, s, False)[0] for s in range(len(ring))])).alias("start", "key"),
    )
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("key")
    full = saved(spark, full, "crowded")
    if full.isEmpty():
        return _linked_pairs(nodes, keyed, ring, distance)
    pairs = _linked_pairs(nodes, keyed.join(full, "key", "left_anti"), ring, distance)
    members = nodes.select("fp", F.explode(_asked_keys(F.col("fp"), ring)).alias("key")).join(full, "key", "left_semi")
    return pairs.union(_midpoint_links(members, distance)).distinct()


def simhash_components(
    spark: SparkSession, docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = CROWD,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` without its text, with columns fingerprint, component_id and component_label.

    Words are the runs of bytes other than space and 09-0D of the text with A-Z lowered; shingles are ``width`` words
    joined by spaces, repeats included (fewer words: the whole sequence). Null and empty texts and those of blanks
    have fingerprint zero and are linked like any other. Fingerprints link at ``distance`` or fewer differing bits;
    component_id is the least id reachable, component_label a fingerprint that names the component. A null id
    keeps its row and counts as the largest (component_id is null only if all ids of the component are). Repeated
    rows stay repeated. A column of ``docs`` that is called like a result column is dropped in its favour. An empty
    table gives an empty result.
    """
    results = ("fingerprint", "component_id", "component_label")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in results])
    fp = fresh_name(docs, "fp")
    printed = saved(spark, with_fingerprints(docs, fp, width, text), "fingerprints")
    nodes = saved(spark, printed.groupBy(F.col(fp).alias("fp")).agg(F.min(id_column).alias("least")), "nodes")
    if distance < 1:
        raise ValueError("distance must be at least 1")
    labels = components(spark, near_links(spark, nodes, distance, crowd))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("component_label")
    )
    named = labelled.groupBy("component_label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(named, "component_label").select(
        F.col("fp").alias("_fp"), "component_label", "component_id"
    )
    return printed.join(of_print, F.col(fp) == F.col("_fp")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), "component_id", "component_label",
    )


def near_duplicates_removed(
    spark: SparkSession, docs: DataFrame, width: int = 4, distance: int = 4, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One whole row of ``docs`` of each component, the one with the least id; of repeated ids one row stays."""
    row = fresh_name(docs, "row_hash")
    hashed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    found = simhash_components(spark, hashed.select(F.col(f"`{id_column}`").alias("id"), F.col(row).alias("row"),
                                                   F.col(f"`{text}`").alias("text")), width, distance, id_column="id")
    kept = (
        found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_label", "id", "row")
        .agg(F.count(F.lit(1)).alias("copies")).groupBy("component_label")
        .agg(F.min(F.struct("id", "row", "copies")).alias("kept"))
        .select(F.col("kept.id").alias("_id"), F.col("kept.row").alias("_row"), F.col("kept.copies").alias("_copies"))
    )
    kept = saved(spark, kept, "kept")
    here = F.col(f"`{id_column}`").eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_row"))
    once = hashed.join(kept.filter("_copies = 1"), here, "left_semi")
    repeated = hashed.join(kept.filter("_copies > 1"), here, "left_semi").dropDuplicates([row])
    return once.union(repeated).drop(row)
