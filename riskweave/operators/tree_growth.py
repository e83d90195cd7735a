"""Many classification trees grown in the same passes over row blocks.

Nodes with many rows are split from histograms that tasks add up per (tree, node, feature, code); a pass takes as many nodes
as their histograms' bytes allow. A node of at most ``local_rows`` draws goes, with its rows, to one task that finishes its
subtree. Both ways count draws in integers and choose the same splits, so where a node changes hands does not change a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.row_blocks import Block, RowBlocks
from riskweave.session import materialised

LOCAL_ROWS = 262_144
#: Bytes of histograms that a task holds in one pass, and of packed rows that the trees grown at a time may shuffle.
HISTOGRAM_BYTES = 1 << 26
SHUFFLED_BYTES = 1 << 31

NODE = np.dtype([("feature", "<i4"), ("left", "<i4"), ("right", "<i4"), ("cut", "<f8"), ("value", "<f8"), ("gain", "<f8")])
TREES = "model int, tree int, node int, nodes binary"

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values: what features are drawn and paths are named by."""
    x = (np.asarray(x, np.uint64) + _STEP) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_features(keys: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """For each key ``count`` of the allowed features without repetition, ascending."""
    if count >= len(allowed):
        return np.tile(allowed, (len(keys), 1))
    with np.errstate(over="ignore"):
        ranks = mixed(keys[:, None] + (allowed[None, :].astype(np.uint64) + np.uint64(1)) * _STEP)
    return np.sort(allowed[np.argpartition(ranks, count - 1, axis=1)[:, :count]], axis=1)


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return mixed(keys * np.uint64(2)), mixed(keys * np.uint64(2) + np.uint64(1))


def root_key(seed: int, model: int, tree: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mixed(mixed(np.uint64(seed)) + mixed(np.uint64(model * 1_000_003 + tree)))


@dataclass(frozen=True)
class ForestSpec:
    """What kind of trees: how many, features looked at per tree and per node (all if None), draws as a share of the
    rows (each row once if None), depth, and whether classes weigh the same."""

    trees: int
    per_tree: int | None = None
    per_node: int | None = None
    share: float | None = None
    depth: int = 1 << 30
    balanced: bool = False
    seed: int = 42


class Drawing:
    """How often each row of a block is drawn for a tree: a bootstrap of an exact size over all blocks, no row ranked.

    The draws are dealt to the blocks by one multinomial of a counter-based generator that every task repeats, and
    within a block by another, so a lost partition draws the same rows again.
    """

    def __init__(self, sizes: np.ndarray, spec: ForestSpec):
        self.sizes, self.spec = sizes, spec
        self.dealt: dict[tuple[int, int], np.ndarray] = {}

    def total(self, model: int) -> int:
        rows = int(self.sizes[:, model].sum())
        return rows if self.spec.share is None else round(self.spec.share * rows)

    def counts(self, block: Block, model: int, tree: int) -> np.ndarray:
        seen = block.seen_by(model)
        counts = np.zeros(len(block.labels), np.int64)
        if self.spec.share is None:
            counts[seen] = 1
            return counts
        dealt = self.dealt.get((model, tree))
        seed = int(root_key(self.spec.seed, model, tree))
        if dealt is None:
            rows = self.sizes[:, model]
            dealt = self.dealt[model, tree] = _generator(seed, 0).multinomial(self.total(model), rows / max(rows.sum(), 1))
        picks = _generator(seed, block.place + 1).integers(0, max(len(seen), 1), dealt[block.place])
        counts[seen] = np.bincount(picks, minlength=len(seen))
        return counts


def _generator(seed: int, stream: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed, stream], np.uint64)))


def purity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over their sum; a split's gain is what it adds to this (the Gini decrease)."""
    weighed = counts * weights
    whole = weighed.sum(axis=-1)
    return (weighed * weighed).sum(axis=-1) / np.where(whole > 0, whole, 1)


def split_gains(left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    gain = purity(left, weights) + purity(right, weights) - purity(left + right, weights)
    return np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -np.inf)


def histogram_split(histogram: np.ndarray, weights: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """Gain, slot, code and left counts of the best split of one node (slots x codes x classes); the first among equals."""
    left = np.cumsum(histogram, axis=1)
    gains = split_gains(left, left[:, -1:, :] - left, weights)
    slot, code = np.unravel_index(gains.argmax(), gains.shape)
    return float(gains[slot, code]), int(slot), int(code), left[slot, code]


def _cell_gains(low: np.ndarray, high: np.ndarray, whole_low: np.ndarray, whole_high: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``split_gains`` of left counts by class, held apart; ``whole``: those of the node, of as many rows or one a node."""
    def pure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = x * weights[0], y * weights[1]
        whole = x + y
        return (x * x + y * y) / np.where(whole > 0, whole, 1)

    right_low, right_high = whole_low - low, whole_high - high
    gain = pure(low, high) + pure(right_low, right_high) - pure(whole_low, whole_high)
    return np.where((low + high > 0) & (right_low + right_high > 0), gain, -np.inf)


def counted_splits(values: np.ndarray, at: np.ndarray, labels: np.ndarray, draws: np.ndarray, totals: np.ndarray, codes: int, weights: np.ndarray):
    """Best gain, code and left counts per node of one feature of few codes, from one histogram of all nodes."""
    place = (at * codes + values) * 2 + labels
    held = np.bincount(place, draws, len(totals) * codes * 2).reshape(len(totals), codes, 2)
    low, high = np.cumsum(held[:, :, 0], axis=1), np.cumsum(held[:, :, 1], axis=1)
    gains = _cell_gains(low, high, totals[:, :1], totals[:, 1:], weights)
    code, nodes = gains.argmax(axis=1), np.arange(len(totals))
    return gains[nodes, code], code, code, np.column_stack([low[nodes, code], high[nodes, code]]).astype(np.int64)


def scanned_splits(values: np.ndarray, at: np.ndarray, labels: np.ndarray, draws: np.ndarray, totals: np.ndarray, weights: np.ndarray):
    """Best gain, code, next code and left counts per node of one integer feature; every node has rows. Rows are sorted, their
    draws packed into the key, so any number of different values will do."""
    many, bits = int(draws.max()).bit_length(), int(values.max()).bit_length()
    key = ((((at << bits) | values) << 1 | labels) << many) | draws
    key.sort()
    draws = key & ((1 << many) - 1)
    cell = key >> (many + 1)
    ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
    high, both = np.cumsum(draws * (key >> many & 1))[ends], np.cumsum(draws)[ends]
    cell = cell[ends]
    node = cell >> bits
    last = np.flatnonzero(np.append(node[1:] != node[:-1], True))
    high = high - np.append(0, high[last[:-1]])[node]
    low = both - np.append(0, both[last[:-1]])[node] - high
    gains = _cell_gains(low, high, totals[node, 0], totals[node, 1], weights)
    best = np.maximum.reduceat(gains, np.append(0, last[:-1] + 1))
    hit = np.flatnonzero(gains == best[node])
    hit = hit[np.append(True, node[hit[1:]] != node[hit[:-1]])]
    value = cell & ((1 << bits) - 1)
    return best, value[hit], value[np.minimum(hit + 1, len(value) - 1)], np.column_stack([low[hit], high[hit]])


def finish(
    codes: np.ndarray, counts: np.ndarray, key: int, depth: int, allowed: np.ndarray, spec: ForestSpec, weights: np.ndarray, cut_of,
) -> np.ndarray:
    """The subtree of some rows (``counts`` by class), level by level with all nodes of a level at once.

    A node ends when it is pure, deep enough, or no feature parts its rows; if none of the drawn features does, it looks at
    all. ``cut_of(features, codes, next codes)`` gives the thresholds. Nodes as ``NODE`` records, the root first.
    """
    levels, made = [], 1
    rows, at = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    labels, draws = (counts[:, 1] > 0).astype(np.int64), counts.sum(axis=1)
    by_feature = np.ascontiguousarray(codes.T)
    keys, totals = np.array([key], np.uint64), counts.sum(axis=0, keepdims=True)
    while len(totals):
        level = np.zeros(len(totals), NODE)
        level["feature"] = -1
        weighed = totals * weights
        level["value"] = weighed[:, 1] / np.maximum(weighed.sum(axis=1), 1e-300)
        levels.append(level)
        live = np.flatnonzero((totals > 0).all(axis=1)) if depth < spec.depth else np.zeros(0, np.int64)
        if not len(live):
            break
        if len(live) < len(totals):
            rows, at, labels, draws = _moved(live, len(totals), rows, at, labels, draws)
        slots = drawn_features(keys[live], allowed, spec.per_node or len(allowed))
        best, feature, code, after, left = _best_of(by_feature, rows, at, labels, draws, totals[live], slots, weights)
        lost = np.flatnonzero(~np.isfinite(best))
        if len(lost) and spec.per_node is not None and spec.per_node < len(allowed):
            every = np.tile(allowed, (len(lost), 1))
            some = _moved(lost, len(live), rows, at, labels, draws)
            best[lost], feature[lost], code[lost], after[lost], left[lost] = _best_of(by_feature, *some, totals[live[lost]], every, weights)
        splits = np.flatnonzero(np.isfinite(best))
        if not len(splits):
            break
        nodes = live[splits]
        level["feature"][nodes], level["gain"][nodes] = feature[splits], best[splits]
        level["cut"][nodes] = cut_of(feature[splits], code[splits], after[splits])
        level["left"][nodes] = made + 2 * np.arange(len(splits))
        level["right"][nodes] = level["left"][nodes] + 1
        made += 2 * len(splits)
        if len(splits) < len(live):
            rows, at, labels, draws = _moved(splits, len(live), rows, at, labels, draws)
        at = 2 * at + (by_feature.ravel().take(feature[splits][at] * len(codes) + rows) > code[splits][at])
        low, high = child_keys(keys[nodes])
        keys = np.column_stack([low, high]).ravel()
        totals = np.stack([left[splits], totals[nodes] - left[splits]], axis=1).reshape(-1, 2)
        depth += 1
    return np.concatenate(levels)


def _moved(kept: np.ndarray, nodes: int, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of some nodes, which are numbered anew."""
    place = np.full(nodes, -1)
    place[kept] = np.arange(len(kept))
    at = place[at]
    inside = np.flatnonzero(at >= 0)
    return rows[inside], at[inside], labels[inside], draws[inside]


def _best_of(
    by_feature: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, draws: np.ndarray, totals: np.ndarray, slots: np.ndarray, weights: np.ndarray,
):
    """Best gain, feature, code, next code and left counts of every node over its slots of features; the first among equals.

    Codes of one byte are counted while nodes have rows enough, else sorted; both find the same.
    """
    best, left = np.full(len(slots), -np.inf), np.zeros((len(slots), 2), np.int64)
    feature, code, after = (np.zeros(len(slots), np.int64) for _ in range(3))
    flat, size = by_feature.ravel(), by_feature.shape[1]
    codes = int(by_feature.max()) + 1 if by_feature.dtype == np.uint8 else 0
    counted = codes and len(totals) * codes <= 2 * len(rows)
    weighed, whole = (draws.astype(np.float64), totals.astype(np.float64)) if counted else (draws, totals)
    for j in range(slots.shape[1]):
        values = flat.take(slots[at, j] * size + rows).astype(np.int64)
        if counted:
            gain, where, following, counts = counted_splits(values, at, labels, weighed, whole, codes, weights)
        else:
            gain, where, following, counts = scanned_splits(values, at, labels, draws, totals, weights)
        better = gain > best
        best[better], feature[better], code[better] = gain[better], slots[better, j], where[better]
        after[better], left[better] = following[better], counts[better]
    return best, feature, code, after, left


@dataclass
class Top:
    """The part of a tree that histograms have grown, on the driver: its size is bounded by rows / local_rows."""

    key: int
    draws: int
    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    keys: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    counts: list = field(default_factory=lambda: [None])
    looks_at_all: set[int] = field(default_factory=set)
    open: set[int] = field(default_factory=lambda: {0})

    def __post_init__(self) -> None:
        self.keys, self.sizes = [self.key], [self.draws]

    def routed(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        feature, code, left, right = (np.array(x) for x in (self.feature, self.code, self.left, self.right))
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while True:
            inner = feature[at[rows]] >= 0
            rows = rows[inner]
            if not len(rows):
                return at
            node = at[rows]
            at[rows] = np.where(codes[rows, feature[node]] <= code[node], left[node], right[node])

    def split(self, node: int, feature: int, code: int, gain: float, left: np.ndarray, whole: np.ndarray, limit: int) -> None:
        self.open.discard(node)
        self.feature[node], self.code[node], self.gain[node] = feature, code, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        keys = [int(k[0]) for k in child_keys(np.array([self.keys[node]], np.uint64))]
        for key, counts in zip(keys, (left, whole - left)):
            if (counts > 0).all() and self.depth[node] + 1 < limit:
                self.open.add(len(self.feature))
            for values, value in ((self.feature, -1), (self.code, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0),
                                  (self.depth, self.depth[node] + 1), (self.keys, key), (self.sizes, int(counts.sum())), (self.counts, counts)):
                values.append(value)

    def nodes(self, weights: np.ndarray, cut_of) -> np.ndarray:
        made = np.zeros(len(self.feature), NODE)
        made["feature"], made["left"], made["right"], made["gain"] = self.feature, self.left, self.right, self.gain
        inner = made["feature"] >= 0
        made["cut"][inner] = cut_of(made["feature"][inner], np.array(self.code)[inner], None)
        for i, counts in enumerate(self.counts):
            if counts is not None:
                weighed = counts * weights
                made["value"][i] = weighed[1] / max(weighed.sum(), 1e-300)
        return made


def rows_by_node(at: np.ndarray, nodes: Iterable[int], size: int) -> list[tuple[int, np.ndarray]]:
    """The places of the rows that have come to each of some nodes (of ``size``), without nodes that have none."""
    wanted = np.zeros(size, bool)
    wanted[list(nodes)] = True
    inside = np.flatnonzero(wanted[at])
    inside = inside[np.argsort(at[inside].astype(np.uint16 if size <= 1 << 16 else np.int64), kind="stable")]
    found, starts = np.unique(at[inside], return_index=True)
    return list(zip(found.tolist(), np.split(inside, starts[1:]))) if len(inside) else []


def cutter(edges: list[np.ndarray]):
    """Thresholds of features and codes: a row goes left if its value is at most that."""
    width = max([1, *map(len, edges)])
    table = np.full((len(edges), width), np.inf)
    for i, cuts in enumerate(edges):
        table[i, : len(cuts)] = cuts
    return lambda features, codes, after=None: table[features, np.minimum(codes, width - 1)]


def class_weights(blocks: RowBlocks, model: int, balanced: bool) -> np.ndarray:
    counts = blocks.classes[model]
    return counts.sum() / (2 * np.maximum(counts, 1)) if balanced else np.ones(2)


def grow_forest(blocks: RowBlocks, spec: ForestSpec, models: Sequence[int] = (0,), local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The trees of every model (a bit of the blocks' masks) as rows of ``TREES``, in the shared folder.

    Node -1 holds a tree's top; other rows the subtrees that take the places of its nodes of that number.
    """
    drawing = Drawing(blocks.sizes, spec)
    weights = {m: class_weights(blocks, m, spec.balanced) for m in models}
    packed = max(1, int(blocks.sizes.max(axis=1, initial=0).sum()) * (blocks.width + 9))
    ids = [(m, t) for m in models for t in range(spec.trees)]
    batches = -(-len(ids) // max(1, SHUFFLED_BYTES // packed))
    step = -(-len(ids) // max(1, batches))  # batches of one size; the shuffle files of one go before the next
    grown = None
    for a in range(0, len(ids), step):
        some = _grow_batch(blocks, spec, drawing, weights, ids[a : a + step], local_rows)
        grown = some if grown is None else grown.unionByName(some)
    return grown


def _allowed(key: int, width: int, spec: ForestSpec) -> np.ndarray:
    return drawn_features(mixed(np.array([key], np.uint64)), np.arange(width), spec.per_tree or width)[0]


def _slots(top: Top, node: int, allowed: np.ndarray, spec: ForestSpec) -> np.ndarray:
    count = len(allowed) if node in top.looks_at_all else spec.per_node or len(allowed)
    return drawn_features(np.array([top.keys[node]], np.uint64), allowed, count)[0]


def _grow_batch(blocks: RowBlocks, spec: ForestSpec, drawing: Drawing, weights: dict, ids: list[tuple[int, int]], local_rows: int) -> DataFrame:
    spark = blocks.spark
    tops = {i: Top(int(root_key(spec.seed, *i)), drawing.total(i[0])) for i in ids}
    allowed = {i: _allowed(top.key, blocks.width, spec) for i, top in tops.items()}
    bins = max([1, *map(len, blocks.edges)]) + 1
    while True:
        big = [(i, n) for i, top in tops.items() for n in sorted(top.open) if top.sizes[n] > local_rows]
        if not big:
            break
        slots = {(i, n): _slots(tops[i], n, allowed[i], spec) for i, n in big}
        room, chosen = HISTOGRAM_BYTES, []
        for which in big:
            room -= len(slots[which]) * bins * 16
            if chosen and room < 0:
                break
            chosen.append(which)
        for (model, tree, node), histogram_of in _histogram_pass(blocks, drawing, tops, chosen, slots, bins, weights).items():
            top = tops[model, tree]
            gain, slot, code, left, whole = histogram_of
            if np.isfinite(gain):
                top.split(node, int(slots[(model, tree), node][slot]), code, gain, left, whole, spec.depth)
            elif len(slots[(model, tree), node]) < len(allowed[model, tree]):
                top.looks_at_all.add(node)
            else:
                top.open.discard(node)
            top.counts[node] = whole
            if (whole == 0).any():
                top.open.discard(node)
    cut_of = cutter(blocks.edges)
    rows = [(m, t, -1, top.nodes(weights[m], cut_of).tobytes()) for (m, t), top in tops.items()]
    made = materialised(_finish_pass(blocks, spec, drawing, weights, tops, allowed), "subtrees")
    return spark.createDataFrame(rows, TREES).unionByName(made)


def _parallel(spark: SparkSession, groups: int) -> int:
    return max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))


def _histogram_pass(blocks: RowBlocks, drawing: Drawing, tops: dict, chosen: list, slots: dict, bins: int, weights: dict) -> dict:
    """Best split and class counts of each chosen node: histograms summed in tasks, then per (tree, node)."""
    spark = blocks.spark
    by_tree: dict[tuple[int, int], list[int]] = {}
    for i, n in chosen:
        by_tree.setdefault(i, []).append(n)
    handed = spark.sparkContext.broadcast((drawing, {i: tops[i] for i in by_tree}, by_tree, slots))
    read = blocks.reader()

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawing, tops, by_tree, slots = handed.value
        held: dict[tuple, np.ndarray] = {}  # by tree and number of slots, the nodes of which are counted together
        asked: dict[tuple, list[int]] = {}
        for (model, tree), nodes in by_tree.items():
            for n in nodes:
                asked.setdefault((model, tree, len(slots[(model, tree), n])), []).append(n)
        for block in read(parts):
            drawn = None
            for (model, tree, width), nodes in asked.items():
                if drawn != (model, tree):
                    drawn, top = (model, tree), tops[model, tree]
                    counts = drawing.counts(block, model, tree)
                    rows = np.flatnonzero(counts)
                    at = top.routed(block.codes[rows])
                number = np.full(len(top.feature), -1)
                number[nodes] = np.arange(len(nodes))
                place = number[at]
                inside = place >= 0
                mine, place = rows[inside], place[inside]
                features, labels, draws = np.array([slots[(model, tree), n] for n in nodes]), block.labels[mine], counts[mine]
                total = held.setdefault((model, tree, width), np.zeros((len(nodes), width, bins, 2), np.int64))
                for j in range(width):
                    cell = (place * bins + block.codes[mine, features[place, j]]) * 2 + labels
                    total[:, j] += np.bincount(cell, draws, len(nodes) * bins * 2).astype(np.int64).reshape(len(nodes), bins, 2)
        held = {(*which[:2], n): total[i] for which, total in held.items() for i, n in enumerate(asked[which])}
        if held:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["model", "tree", "node", "raw"])

    def best(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, np.int64) for raw in table.column("raw").to_pylist()).reshape(-1, bins, 2)
        model = key[0].as_py()
        gain, slot, code, left = histogram_split(total, weights[model])
        values = [*[k.as_py() for k in key], gain, slot, code, *left.tolist(), *total[0].sum(axis=0).tolist()]
        return pa.table({n: [v] for n, v in zip(("model", "tree", "node", "gain", "slot", "code", "l0", "l1", "n0", "n1"), values)})

    partial = blocks.table.mapInArrow(counted, "model int, tree int, node int, raw binary")
    dealt = partial.repartition(_parallel(spark, len(chosen)), "model", "tree", "node").groupBy("model", "tree", "node")
    found = dealt.applyInArrow(best, "model long, tree long, node long, gain double, slot long, code long, l0 long, l1 long, n0 long, n1 long").collect()
    handed.unpersist()
    return {(r["model"], r["tree"], r["node"]): (r["gain"], r["slot"], r["code"], np.array([r["l0"], r["l1"]]), np.array([r["n0"], r["n1"]])) for r in found}


def _finish_pass(blocks: RowBlocks, spec: ForestSpec, drawing: Drawing, weights: dict, tops: dict, allowed: dict) -> DataFrame:
    """The subtrees of all nodes still open: their drawn rows, packed, go to one task a node."""
    spark = blocks.spark
    waiting = {i: top for i, top in tops.items() if top.open}
    handed = spark.sparkContext.broadcast((drawing, waiting, allowed))
    read, edges, width = blocks.reader(), blocks.edges, blocks.width

    def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawing, tops, _ = handed.value
        for block in read(parts):
            for (model, tree), top in tops.items():
                counts = drawing.counts(block, model, tree)
                rows = np.flatnonzero(counts)
                at = top.routed(block.codes[rows])
                there = [(n, rows[some]) for n, some in rows_by_node(at, top.open, len(top.feature))]
                if there:
                    raws = [[x[mine].tobytes() for _, mine in there] for x in (block.codes, block.labels, counts.astype(np.uint32))]
                    columns = [pa.array([value] * len(there), pa.int32()) for value in (model, tree)]
                    columns += [pa.array([n for n, _ in there], pa.int32()), *[pa.array(raw, pa.binary()) for raw in raws]]
                    yield pa.RecordBatch.from_arrays(columns, names=["model", "tree", "node", "codes", "labels", "counts"])

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        _, tops, allowed = handed.value
        model, tree, node = (k.as_py() for k in key)
        codes, labels, draws = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("codes", np.uint8), ("labels", np.uint8), ("counts", np.uint32)))
        counts = np.zeros((len(labels), 2), np.int64)
        counts[np.arange(len(labels)), labels] = draws
        top = tops[model, tree]
        made = finish(codes.reshape(-1, width), counts, top.keys[node], top.depth[node], allowed[model, tree], spec, weights[model], cutter(edges))
        return pa.table({"model": pa.array([model], pa.int32()), "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "nodes": pa.array([made.tobytes()], pa.binary())})

    groups = sum(len(top.open) for top in waiting.values())
    packed = blocks.table.mapInArrow(sent, "model int, tree int, node int, codes binary, labels binary, counts binary")
    return packed.repartition(_parallel(spark, groups), "model", "tree", "node").groupBy("model", "tree", "node").applyInArrow(grown, TREES)


def whole_tree(top: bytes, subtrees: dict[int, bytes]) -> np.ndarray:
    """One array of nodes: the top, with its open nodes replaced by their subtrees."""
    pieces = [np.frombuffer(top, NODE).copy()]
    size = len(pieces[0])
    for node, raw in sorted(subtrees.items()):
        sub = np.frombuffer(raw, NODE).copy()
        inner = sub["feature"] >= 0
        for side in ("left", "right"):  # the subtree's root takes the node's place, the rest follows the nodes so far
            sub[side][inner] += size - 1
        pieces[0][node] = sub[0]
        pieces.append(sub[1:])
        size += len(sub) - 1
    return np.concatenate(pieces)


def importances(trees: DataFrame, width: int) -> np.ndarray:
    """Mean over trees of each feature's share of the tree's gains, as in a forest's Gini importance."""

    def gains(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for raw in part.column("nodes").to_pylist():
                nodes = np.frombuffer(raw, NODE)
                inner = nodes["feature"] >= 0
                found.append(np.bincount(nodes["feature"][inner], nodes["gain"][inner], width).tolist())
            yield pa.RecordBatch.from_arrays([part.column("tree"), pa.array(found, pa.list_(pa.float64()))], names=["tree", "gains"])

    summed = trees.select("tree", "nodes").mapInArrow(gains, "tree int, gains array<double>")
    per_tree = summed.groupBy("tree").agg(*[F.sum(F.col("gains")[i]).alias(f"g{i}") for i in range(width)])
    whole = sum((F.col(f"g{i}") for i in range(width)), F.lit(0.0))
    row = per_tree.where(whole > 0).agg(*[F.avg(F.col(f"g{i}") / whole).alias(f"g{i}") for i in range(width)]).first()
    return np.array([row[i] or 0.0 for i in range(width)])
