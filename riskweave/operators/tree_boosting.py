"""Boosted trees and stumps over row blocks: a pass adds up histograms in tasks, per node.

While all tasks' histograms of a level of trees are some megabytes, the driver adds them up and finds the splits: a pass is one
stage, and of two children only the one with fewer rows is counted, the other is what remains of the parent. Beyond that they
are added up by node in a second stage, which hands back only splits; both find the same trees. A model whose rows are at most
WHOLE_BYTES needs no passes: one task grows all its trees, the same ones, while other tasks grow the other models.

Gradients and Hessians are rounded to fixed-point integers, so that sums do not depend on how rows are dealt. The rows are
kept by the executors with their margins, or the weights of stumps: a tree is applied to each row once, when it is grown, and
every so many trees the rows are checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.row_blocks import RowBlocks
from riskweave.operators.tree_growth import HISTOGRAM_BYTES, NODE, TREES, _generator, cutter, drawn_features, mixed, root_key, rows_by_node, split_gains
from riskweave.session import scratch_path, shared_dir

#: Unit of gradient sums; rounds between checkpoints of the rows; the least gain of a split; blocks in a partition.
SCALE = 1 << 24
WRITTEN_EVERY = 25
LEAST_GAIN = 1e-6
PARTITION_BLOCKS = 16
#: Bytes of histograms of all tasks that the driver adds up in a pass; rows of blocks that are kept as one.
DRIVER_BYTES = 1 << 26
MERGED_ROWS = 1 << 17
#: Bytes of a model's rows, with what its trees make of them, that one task may hold; those of a row besides its codes.
WHOLE_BYTES = 1 << 28
ROW_BYTES = 128
#: Combinations of codes of features that are counted together.
GROUP_CELLS = 1 << 12


@dataclass(frozen=True)
class BoostSpec:
    rounds: int
    step: float = 0.05
    depth: int = 6
    row_share: float = 0.9
    feature_share: float = 0.9
    seed: int = 42
    ridge: float = 1.0
    least_weight: float = 1.0


@dataclass
class CodedTree:
    """A small tree over codes; leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    code: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    rows: list[int] = field(default_factory=lambda: [0])
    open: set[int] = field(default_factory=lambda: {0})

    def routed(self, by_feature: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node that each of some rows has come to; codes are given by feature."""
        feature, code, left, right = (np.array(x) for x in (self.feature, self.code, self.left, self.right))
        flat, size = by_feature.ravel(), by_feature.shape[1]
        at, moving = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while True:
            moving = moving[feature[at[moving]] >= 0]
            if not len(moving):
                return at
            node = at[moving]
            at[moving] = np.where(flat.take(feature[node] * size + rows[moving]) <= code[node], left[node], right[node])

    def outputs(self, by_feature: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.routed(by_feature, np.arange(by_feature.shape[1]))]

    def split(self, node: int, feature: int, code: int, gain: float, sides: Sequence[tuple[float, int]], limit: int) -> None:
        """``sides``: output and rows of either child."""
        self.open.discard(node)
        self.feature[node], self.code[node], self.gain[node] = feature, code, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for value, rows in sides:
            if self.depth[node] + 1 < limit:
                self.open.add(len(self.feature))
            for values, new in ((self.feature, -1), (self.code, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0),
                                (self.depth, self.depth[node] + 1), (self.rows, rows)):
                values.append(new)

    def grafted(self, node: int, other: CodedTree) -> None:
        """Puts another tree in the place of an open node."""
        base = len(self.feature) - 1
        self.open.discard(node)
        for name in ("feature", "code", "left", "right", "value", "gain"):
            mine, theirs = getattr(self, name), list(getattr(other, name))
            if name in ("left", "right"):
                theirs = [x + base if f >= 0 else x for x, f in zip(theirs, other.feature)]
            mine[node] = theirs[0]
            mine.extend(theirs[1:])
        self.depth.extend([self.depth[node] + d for d in other.depth[1:]])
        self.rows.extend(other.rows[1:])

    def nodes(self, cut_of) -> np.ndarray:
        made = np.zeros(len(self.feature), NODE)
        for name in ("feature", "left", "right", "value", "gain"):
            made[name] = getattr(self, name)
        inner = made["feature"] >= 0
        made["cut"][inner] = cut_of(made["feature"][inner], np.array(self.code)[inner])
        return made


def gradients(margin: np.ndarray, labels: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss, rows of class 1 weighted, in units of 1 / SCALE."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(labels == 1, weight, 1.0)
    return np.rint(w * (p - labels) * SCALE).astype(np.int64), np.rint(w * np.maximum(p * (1 - p), 1e-16) * SCALE).astype(np.int64)


def leaf(g: int, h: int, spec: BoostSpec) -> float:
    return -(g / SCALE) / (h / SCALE + spec.ridge) * spec.step


def class_weight(counts: np.ndarray) -> float:
    """The weight of the rows of class 1."""
    return float(counts[0] / max(counts[1], 1))


def tree_features(spec: BoostSpec, model: int, number: int, width: int) -> np.ndarray:
    """The features of a tree."""
    key = mixed(np.array([root_key(spec.seed, model, number)], np.uint64))
    return drawn_features(key, np.arange(width), max(1, int(spec.feature_share * width)))[0]


def best_newton_split(histogram: np.ndarray, spec: BoostSpec) -> tuple[float, int, int, np.ndarray]:
    """Gain, slot, code and left sums (g, h, rows) of a node's best split; the first among equals, -inf if none is allowed."""
    left = np.cumsum(histogram, axis=1)
    whole = left[:, -1:, :]
    (gl, hl), (gr, hr), (g, h) = ((x[..., 0] / SCALE, x[..., 1] / SCALE) for x in (left, whole - left, whole))
    gain = gl * gl / (hl + spec.ridge) + gr * gr / (hr + spec.ridge) - g * g / (h + spec.ridge)
    allowed = (hl >= spec.least_weight) & (hr >= spec.least_weight) & (left[..., 2] > 0) & (left[..., 2] < whole[..., 2]) & (gain > LEAST_GAIN)
    gain = np.where(allowed, gain, -np.inf)
    slot, code = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[slot, code]), int(slot), int(code), left[slot, code]


def summed_nodes(
    by_feature: np.ndarray, rows: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, bins: int, nodes: int,
) -> np.ndarray:
    """Sums of g, h and rows per (node, slot, code)."""
    found = np.empty((nodes, len(features), bins, 3), np.int64)
    base, g, h = at * bins, g.astype(np.float64), h.astype(np.float64)
    for j, f in enumerate(features.tolist()):
        place = base + by_feature[f].take(rows)
        for k, values in enumerate((g, h, None)):
            found[:, j, :, k] = np.rint(np.bincount(place, values, nodes * bins)).reshape(nodes, bins)
    return found


def summed_cells(
    by_feature: np.ndarray, rows: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, starts: np.ndarray, nodes: int,
) -> np.ndarray:
    """The same sums per (node, cell): the codes of all features in a row, those of slot j from ``starts[j]`` on."""
    found = np.empty((nodes, starts[-1], 3), np.int64)
    g, h = g.astype(np.float64), h.astype(np.float64)
    for f, a, b in zip(features.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        place = at * (b - a)
        place += by_feature[f].take(rows)
        for k, values in enumerate((g, h, None)):
            found[:, a:b, k] = np.rint(np.bincount(place, values, nodes * (b - a))).reshape(nodes, b - a)
    return found


def cell_groups(codes: np.ndarray) -> list[list[int]]:
    """The features in groups that have at most GROUP_CELLS combinations of codes (or are a single feature)."""
    groups: list[tuple[list[int], int]] = []
    for f in np.argsort(-codes, kind="stable").tolist():
        for i, (group, cells) in enumerate(groups):
            if cells * codes[f] <= GROUP_CELLS:
                groups[i] = [*group, f], cells * int(codes[f])
                break
        else:
            groups.append(([f], int(codes[f])))
    return [group for group, _ in groups]


def grouped_codes(by_feature: np.ndarray, codes: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The number of each row's combination of codes in each group, the last feature's code counting fastest."""
    found = []
    for group in groups:
        place = by_feature[group[0]].astype(np.int32)
        for f in group[1:]:
            place = place * int(codes[f]) + by_feature[f]
        found.append(place.astype(np.uint16))
    return found


def summed_groups(
    grouped: list[np.ndarray], groups: list[list[int]], codes: np.ndarray, rows: np.ndarray | None, at: np.ndarray, g: np.ndarray, h: np.ndarray,
    features: np.ndarray, starts: np.ndarray, nodes: int, columns: int = 3,
) -> np.ndarray:
    """What ``summed_cells`` gives, or its first ``columns``, from one count of the combinations of each group; without ``rows``
    of all rows, in one node. All sums are whole numbers below 2 ** 53."""
    found = np.empty((nodes, starts[-1], columns), np.int64)
    slots = {f: j for j, f in enumerate(features.tolist())}
    for place, group in zip(grouped, groups):
        wanted = [f for f in group if f in slots]
        if not wanted:
            continue
        cells = int(np.prod(codes[group]))
        if rows is not None:
            place = place.take(rows) + at * cells
        for k, values in enumerate((g, h, None)[:columns]):
            held = np.bincount(place, values, nodes * cells).reshape(nodes, cells)
            for f in group:
                held = held.reshape(nodes, int(codes[f]), -1)
                if f in slots:
                    found[:, starts[slots[f]] : starts[slots[f] + 1], k] = held.sum(axis=2)
                held = held.sum(axis=1)
    return found


def best_cell_splits(sums: np.ndarray, starts: np.ndarray, spec: BoostSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gain, cell, left and whole sums of the best split of every node; what ``best_newton_split`` finds of each. Rows need not
    be counted where both sides must weigh something."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, starts[1] - 1].copy()
    left[:, starts[1] :] -= np.repeat(left[:, starts[1:-1] - 1], np.diff(starts)[1:], axis=1)
    (gl, hl), (gr, hr), (g, h) = ((x[..., 0] / SCALE, x[..., 1] / SCALE) for x in (left, whole[:, None] - left, whole[:, None]))
    gain = gl * gl / (hl + spec.ridge) + gr * gr / (hr + spec.ridge) - g * g / (h + spec.ridge)
    allowed = (hl >= spec.least_weight) & (hr >= spec.least_weight) & (gain > LEAST_GAIN)
    if sums.shape[-1] > 2:
        allowed &= (left[..., 2] > 0) & (left[..., 2] < whole[:, None, 2])
    gain = np.where(allowed, gain, -np.inf)
    cell, nodes = gain.argmax(axis=1), np.arange(len(sums))
    return gain[nodes, cell], cell, left[nodes, cell], whole


def split_nodes(tree: CodedTree, sums: dict[int, np.ndarray], features: np.ndarray, starts: np.ndarray, spec: BoostSpec) -> None:
    """Splits the nodes whose sums per cell are given, or ends them."""
    nodes = sorted(sums)
    gains, cells, lefts, wholes = best_cell_splits(np.stack([sums[n] for n in nodes]), starts, spec)
    for node, gain, cell, left, whole in zip(nodes, gains.tolist(), cells.tolist(), lefts.tolist(), wholes.tolist()):
        right = [a - b for a, b in zip(whole, left)]
        if node == 0:
            tree.value[0] = leaf(whole[0], whole[1], spec)
        if not np.isfinite(gain):
            tree.open.discard(node)
            continue
        slot = int(np.searchsorted(starts, cell, "right")) - 1
        sides = [(leaf(x[0], x[1], spec), x[2] if len(x) > 2 else 0) for x in (left, right)]
        tree.split(node, int(features[slot]), cell - int(starts[slot]), gain, sides, spec.depth)


def newton_subtree(by_feature: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, bins: int, depth: int, spec: BoostSpec) -> CodedTree:
    """The tree of some rows, ``depth`` levels at most, all nodes of a level at once."""
    tree = CodedTree(value=[leaf(int(g.sum()), int(h.sum()), spec)], rows=[len(g)])
    rows, at, nodes = np.arange(len(g)), np.zeros(len(g), np.int64), [0] if depth > 0 else []
    while nodes:
        sums = summed_nodes(by_feature, rows, at, g[rows], h[rows], features, bins, len(nodes))
        place, following = np.full((2, len(nodes)), -1), []
        feature, code = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for i, node in enumerate(nodes):
            gain, slot, cut, left = best_newton_split(sums[i], spec)
            if not np.isfinite(gain):
                continue
            right = sums[i][slot].sum(axis=0) - left
            feature[i], code[i] = features[slot], cut
            tree.split(node, int(features[slot]), cut, gain, [(leaf(int(x[0]), int(x[1]), spec), int(x[2])) for x in (left, right)], depth)
            if tree.depth[node] + 1 < depth:
                place[:, i] = len(following), len(following) + 1
                following += [tree.left[node], tree.right[node]]
        right = by_feature.ravel().take(feature[at] * len(g) + rows) > code[at]
        at = place[right.astype(np.int64), at]
        rows, at = rows[at >= 0], at[at >= 0]
        nodes = following
    tree.open = set()
    return tree


@dataclass
class KeptBlock:
    """The rows of a block, or of some, as an executor keeps them: codes by feature, and what the trees so far make of each row.

    ``parts`` holds the place and the rows of each block. ``state`` is margins as of the last checkpoint and what came to them
    since (2 x models x rows), or weights (models x rows).
    """

    parts: list[tuple[int, int]]
    by_feature: np.ndarray
    labels: np.ndarray
    members: np.ndarray
    state: np.ndarray

    @property
    def place(self) -> int:
        return self.parts[0][0]

    def drawn(self, model: int, seed: int, share: float) -> np.ndarray:
        """The rows that a tree of a model learns from: a draw per row that the model sees, block by block."""
        found, start = [], 0
        for place, n in self.parts:
            seen = np.flatnonzero(self.members[start : start + n] >> model & 1)
            found.append(seen[_generator(seed, place + 1).random(len(seen)) < share] + start)
            start += n
        return np.concatenate(found)


def merged(blocks: Sequence[KeptBlock]) -> KeptBlock:
    """Blocks in their order as one."""
    if len(blocks) == 1:
        return blocks[0]
    parts = [part for b in blocks for part in b.parts]
    return KeptBlock(parts, *[np.concatenate([getattr(b, name) for b in blocks], axis=-1) for name in ("by_feature", "labels", "members", "state")])


def gathered(blocks: Iterator[KeptBlock], rows: int) -> Iterator[KeptBlock]:
    """Blocks one after the other made one, of ``rows`` rows at most unless a single one has more."""
    held: list[KeptBlock] = []
    for block in blocks:
        if held and sum(len(b.labels) for b in held) + len(block.labels) > rows:
            yield merged(held)
            held = []
        held.append(block)
    if held:
        yield merged(held)


class _KeptRows:
    """The blocks in the executors' memory, or on their disks, from one tree to the next."""

    def __init__(self, blocks: RowBlocks, fresh: Callable[[int], np.ndarray], merged_rows: int = 0):
        spark = blocks.spark
        shared_dir(spark)  # names the checkpoint folder
        tasks = spark.sparkContext.defaultParallelism
        parts = max(1, min(len(blocks.places), tasks * -(-len(blocks.places) // (tasks * PARTITION_BLOCKS))))
        places, width = blocks.places, blocks.width

        def kept(r) -> tuple[int, KeptBlock]:
            codes, labels = np.frombuffer(r["codes"], np.uint8).reshape(-1, width), np.frombuffer(r["labels"], np.uint8)
            place = places[r["part"], r["seq"]]
            return place, KeptBlock([(place, len(labels))], np.ascontiguousarray(codes.T), labels, np.frombuffer(r["members"], np.int64), fresh(len(labels)))

        # blocks in the order of their places within a partition: sums of floats are the same when one is computed again
        dealt = blocks.table.rdd.map(kept).partitionBy(parts, lambda place: place % parts)
        sorted_part = lambda part: gathered(iter(sorted((b for _, b in part), key=lambda b: b.place)), merged_rows)
        self.now: RDD = self._held(dealt.mapPartitions(sorted_part, preservesPartitioning=True))
        self.before: RDD | None = None
        self.spark, self.written = spark, None

    @staticmethod
    def _held(rows: RDD) -> RDD:
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    def advance(self, step: Callable[[KeptBlock], KeptBlock], write: bool) -> None:
        """The next state of all rows, computed by the next pass; lineage ends at a checkpoint if ``write``."""
        self.drop_before()
        self.before, self.now = self.now, self._held(self.now.map(step))
        if write:
            self.now.checkpoint()
            self.now.count()
            self._forget()
            self.written = self.now.getCheckpointFile()

    def drop_before(self) -> None:
        if self.before is not None:
            self.before.unpersist()

    def _forget(self) -> None:
        if self.written:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.written)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        self.drop_before()
        self.now.unpersist()
        self._forget()


class _Boosting:
    """What the passes of one boosting run share."""

    def __init__(self, blocks: RowBlocks, spec: BoostSpec, models: Sequence[int], local_rows: int):
        self.blocks, self.spec, self.models, self.local_rows = blocks, spec, list(models), local_rows
        self.bins = max([1, *map(len, blocks.edges)]) + 1
        shape = (2, len(self.models))
        self.rows = _KeptRows(blocks, lambda n: np.zeros((*shape, n)), MERGED_ROWS)
        self.codes = np.array([len(e) + 1 for e in blocks.edges], np.int64)  # codes of each feature
        counts = {m: blocks.classes[m] for m in models}
        self.weight = {m: class_weight(c) for m, c in counts.items()}
        self.seen = {m: int(c.sum()) for m, c in counts.items()}

    def apply(self, trees: dict[int, CodedTree], write: bool) -> None:
        """Adds the outputs of new trees to the margins."""
        models = self.models

        def applied(block: KeptBlock) -> KeptBlock:
            written, since = block.state[0], block.state[1].copy()
            for i, m in enumerate(models):
                since[i] += trees[m].outputs(block.by_feature)
            state = np.stack([written + since, np.zeros_like(since)]) if write else np.stack([written, since])
            return replace(block, state=state)

        self.rows.advance(applied, write)

    def round(self, number: int) -> dict[int, CodedTree]:
        """The next tree of every model: passes until no node is open."""
        trees = {m: CodedTree(rows=[self.seen[m]]) for m in self.models}
        allowed = {m: tree_features(self.spec, m, number, self.blocks.width) for m in self.models}
        starts = {m: np.append(0, np.cumsum(self.codes[f])) for m, f in allowed.items()}
        sums: dict[int, dict[int, np.ndarray]] = {m: {} for m in self.models}  # of the nodes that were counted last
        while any(t.open for t in trees.values()):
            if self._on_driver(trees, starts):
                for m, found in self._counted(number, trees, allowed, starts, sums).items():
                    split_nodes(trees[m], found, allowed[m], starts[m], self.spec)
                    sums[m] = found
                continue
            sums = {m: {} for m in self.models}
            chosen, room = [], HISTOGRAM_BYTES
            for m, t in trees.items():
                for n in sorted(t.open):
                    big = self._big(t, n)
                    room -= len(allowed[m]) * self.bins * 24 if big else 0
                    if room >= 0 or not chosen:
                        chosen.append((m, n, big))
            for m, node, grown, solved in self._pass(number, trees, allowed, chosen):
                tree = trees[m]
                if grown is not None:
                    tree.grafted(node, grown)
                    continue
                gain, feature, code, left, right = solved
                if node == 0:
                    tree.value[0] = leaf(left[0] + right[0], left[1] + right[1], self.spec)
                if feature < 0:
                    tree.open.discard(node)
                    continue
                tree.split(node, feature, code, gain, [(leaf(x[0], x[1], self.spec), x[2]) for x in (left, right)], self.spec.depth)
        return trees

    def _big(self, tree: CodedTree, node: int) -> bool:
        """Whether a node is counted; below a counted root few rows are sent."""
        return tree.rows[node] > (self.local_rows >> 4 if node else self.local_rows)

    def _on_driver(self, trees: dict[int, CodedTree], starts: dict[int, np.ndarray]) -> bool:
        """Whether the driver adds up the next level: there is a node to count, and all tasks' histograms are small."""
        size = sum(len(t.open) * int(starts[m][-1]) * 24 for m, t in trees.items())
        return size * self.rows.now.getNumPartitions() <= DRIVER_BYTES and any(self._big(t, n) for t in trees.values() for n in t.open)

    def _counted(
        self, number: int, trees: dict[int, CodedTree], allowed: dict[int, np.ndarray], starts: dict[int, np.ndarray], parents: dict[int, dict[int, np.ndarray]],
    ) -> dict[int, dict[int, np.ndarray]]:
        """Sums per cell of every open node. Of two children of a node whose sums are known, the smaller one is counted."""
        spec, models, weight = self.spec, self.models, self.weight
        rest: dict[int, list[tuple[int, int, int]]] = {}  # the larger child, the smaller one, the parent
        for m, t in trees.items():
            sides = [(n, t.left[n], t.right[n]) for n in parents[m] if t.feature[n] >= 0 and {t.left[n], t.right[n]} <= t.open]
            rest[m] = [(*sorted((a, b), key=lambda n, t=t: -t.rows[n]), n) for n, a, b in sides]
        nodes = {m: sorted(t.open - {large for large, _, _ in rest[m]}) for m, t in trees.items() if t.open}
        now = {m: trees[m] for m in nodes}

        def summed(blocks: Iterator[KeptBlock]) -> Iterator[tuple[int, np.ndarray]]:
            held: dict[int, np.ndarray] = {}
            for block in blocks:
                for m, wanted in nodes.items():
                    rows = block.drawn(m, int(root_key(spec.seed, m, number)), spec.row_share)
                    places = np.full(len(now[m].feature), -1)
                    places[wanted] = np.arange(len(wanted))
                    at = places[now[m].routed(block.by_feature, rows)]
                    rows, at = rows[at >= 0], at[at >= 0]
                    margin = (block.state[0, models.index(m)] + block.state[1, models.index(m)])[rows]
                    g, h = gradients(margin, block.labels[rows], weight[m])
                    found = summed_cells(block.by_feature, rows, at, g, h, allowed[m], starts[m], len(wanted))
                    held[m] = held[m] + found if m in held else found
            yield from held.items()

        totals = {m: np.zeros((len(wanted), starts[m][-1], 3), np.int64) for m, wanted in nodes.items()}
        for m, found in self.rows.now.mapPartitions(summed).collect():
            totals[m] += found
        self.rows.drop_before()
        counted = {m: dict(zip(nodes[m], total)) for m, total in totals.items()}
        for m, found in counted.items():
            for large, small, parent in rest[m]:
                found[large] = parents[m][parent] - found[small]
        return counted

    def _pass(self, number: int, trees: dict[int, CodedTree], allowed: dict[int, np.ndarray], chosen: list[tuple[int, int, bool]]) -> list:
        """Model, node, and its subtree if one task has finished it, else its split and the sums of both sides."""
        spec, bins, models, width, weight = self.spec, self.bins, self.models, self.blocks.width, self.weight
        by_model: dict[int, list[tuple[int, int, bool]]] = {}
        for place, (m, n, big) in enumerate(chosen):
            by_model.setdefault(m, []).append((place, n, big))
        now = {m: trees[m] for m in by_model}

        def summed(blocks: Iterator[KeptBlock]) -> Iterator[tuple[int, object]]:
            held: dict[int, np.ndarray] = {}
            for block in blocks:
                for m, nodes in by_model.items():
                    rows = block.drawn(m, int(root_key(spec.seed, m, number)), spec.row_share)
                    margin = (block.state[0, models.index(m)] + block.state[1, models.index(m)])[rows]
                    g, h = gradients(margin, block.labels[rows], weight[m])
                    at = now[m].routed(block.by_feature, rows)
                    big = [(place, n) for place, n, is_big in nodes if is_big]
                    if big:
                        places = np.full(len(now[m].feature), -1)
                        places[[n for _, n in big]] = np.arange(len(big))
                        which = places[at]
                        some = np.flatnonzero(which >= 0)
                        found = summed_nodes(block.by_feature, rows[some], which[some], g[some], h[some], allowed[m], bins, len(big))
                        for (place, _), total in zip(big, found):
                            held[place] = held[place] + total if place in held else total
                    small = {n: place for place, n, is_big in nodes if not is_big}
                    for n, mine in rows_by_node(at, small, len(now[m].feature)):
                        yield small[n], (block.by_feature[:, rows[mine]], g[mine], h[mine])
            yield from held.items()

        def solved(parts: Iterator[tuple[int, object]]) -> Iterator[tuple]:
            found: dict[int, list] = {}
            for place, what in parts:
                found.setdefault(place, []).append(what)
            for place, some in found.items():
                m, n, big = chosen[place]
                if not big:
                    codes, g, h = (np.concatenate([x[i] for x in some], axis=-1) for i in range(3))
                    yield m, n, newton_subtree(codes, g, h, allowed[m], bins, spec.depth - now[m].depth[n], spec), None
                    continue
                total = sum(some)
                gain, slot, code, left = best_newton_split(total, spec)
                split, whole = np.isfinite(gain), total[0].sum(axis=0)
                yield m, n, None, (gain if split else 0.0, int(allowed[m][slot]) if split else -1, code, left.tolist(), (whole - left).tolist())

        groups = max(1, min(len(chosen), self.blocks.spark.sparkContext.defaultParallelism))
        found = self.rows.now.mapPartitions(summed).partitionBy(groups, lambda place: place % groups).mapPartitions(solved).collect()
        self.rows.drop_before()
        there = {(m, n) for m, n, _, _ in found}
        # a node that none of the drawn rows has come to ends
        return found + [(m, n, CodedTree(value=[trees[m].value[n]], open=set()), None) for m, n, _ in chosen if (m, n) not in there]


def grow_boosted(
    blocks: RowBlocks, spec: BoostSpec, models: Sequence[int], local_rows: int, written_every: int = WRITTEN_EVERY, whole_bytes: int = 0
) -> DataFrame:
    """The boosted trees of every model (a bit of the blocks' masks) as rows of ``TREES``; margins start at 0.

    Where no model has more than ``whole_bytes`` of rows, each is grown by one task, else all of them in passes over all rows.
    """
    if max(int(blocks.classes[m].sum()) for m in models) * (blocks.width + ROW_BYTES) <= whole_bytes and blocks.width:
        return _table(blocks.spark, _grow_whole(blocks, spec, models, written_every), "boosted")
    run = _Boosting(blocks, spec, models, local_rows)
    rows, cut_of = [], cutter(blocks.edges)
    for number in range(spec.rounds):
        trees = run.round(number)
        rows += [(m, number, -1, tree.nodes(cut_of).tobytes()) for m, tree in trees.items()]
        if number + 1 < spec.rounds:
            run.apply(trees, (number + 1) % written_every == 0)
    run.rows.release()
    return _table(blocks.spark, rows, "boosted")


class _WholeModel:
    """A model whose rows, those it learns from, are all in one task."""

    def __init__(self, model: int, block: KeptBlock, spec: BoostSpec, codes: np.ndarray, weight: float, written_every: int):
        self.model, self.block, self.spec, self.codes, self.weight, self.written_every = model, block, spec, codes, weight, written_every
        self.groups = cell_groups(codes)
        self.grouped = grouped_codes(block.by_feature, codes, self.groups)
        self.cells = max(int(np.prod(codes[group])) for group in self.groups)
        self.written, self.since = np.zeros((2, len(block.labels)))

    def _sums(self, rows: np.ndarray | None, at: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, starts: np.ndarray, nodes: int) -> np.ndarray:
        if len(g) < 2 * nodes * self.cells:
            rows = np.arange(len(g)) if rows is None else rows
            return summed_cells(self.block.by_feature, rows, at, g, h, features, starts, nodes)[..., : self._columns]
        return summed_groups(self.grouped, self.groups, self.codes, rows, at, g, h, features, starts, nodes, self._columns)

    @property
    def _columns(self) -> int:
        """Sums per cell: where each side of a split must weigh something, rows need not be counted."""
        return 2 if self.spec.least_weight > 0 else 3

    def _drawn(self, seed: int) -> np.ndarray:
        """For each row whether a tree learns from it, as ``KeptBlock.drawn`` draws; the model sees all rows here."""
        draws, start = np.empty(len(self.block.labels)), 0
        for place, n in self.block.parts:
            _generator(seed, place + 1).random(out=draws[start : start + n])
            start += n
        return draws < self.spec.row_share

    def tree(self, number: int) -> CodedTree:
        """The next tree, which is added to the margins. The rows of a node stand together, and of two children only the smaller
        one is counted."""
        spec, by_feature = self.spec, self.block.by_feature
        features = tree_features(spec, self.model, number, len(self.codes))
        starts = np.append(0, np.cumsum(self.codes[features]))
        drawn = self._drawn(int(root_key(spec.seed, self.model, number)))
        order = np.flatnonzero(drawn)
        g, h = (x * drawn for x in gradients(self.written + self.since, self.block.labels, self.weight))  # rows not drawn add nothing
        g, h = g.astype(np.float64), h.astype(np.float64)
        tree = CodedTree(rows=[len(order)])
        spans, ends = {0: (0, len(order))}, []  # where the rows of open nodes stand; rows and outputs of those that ended
        parents: list[tuple[int, int, np.ndarray]] = []  # smaller child, larger child, sums
        while tree.open:
            if not parents and self._columns == 2:
                sums = {0: self._sums(None, np.zeros(len(g), np.int64), g, h, features, starts, 1)[0]}
            else:
                counted = [small for small, _, _ in parents] or [0]
                rows = np.concatenate([order[slice(*spans[n])] for n in counted])
                at = np.repeat(np.arange(len(counted)), [spans[n][1] - spans[n][0] for n in counted])
                sums = dict(zip(counted, self._sums(rows, at, g.take(rows), h.take(rows), features, starts, len(counted))))
            for small, large, whole in parents:
                sums[large] = whole - sums[small]
            split_nodes(tree, sums, features, starts, spec)
            parents = []
            for n in sorted(sums):
                a, b = spans.pop(n)
                rows, low, high = order[a:b], tree.left[n], tree.right[n]
                if tree.feature[n] < 0:
                    ends.append((rows, tree.value[n]))
                    continue
                left = by_feature[tree.feature[n]].take(rows) <= tree.code[n]
                if low not in tree.open:
                    ends.append((rows, np.where(left, tree.value[low], tree.value[high])))
                    continue
                kept = rows[left]
                order[a + len(kept) : b] = rows[~left]
                order[a : a + len(kept)] = kept
                spans[low], spans[high] = (a, a + len(kept)), (a + len(kept), b)
                small, large = (high, low) if len(kept) > b - a - len(kept) else (low, high)
                parents.append((small, large, sums[n]))
        for rows, values in ends:
            self.since[rows] += values
        rest = np.flatnonzero(~drawn)
        self.since[rest] += np.array(tree.value)[tree.routed(by_feature, rest)]
        if (number + 1) % self.written_every == 0:  # the order of the additions is that of the passes
            self.written, self.since = self.written + self.since, np.zeros_like(self.since)
        return tree


def _grow_whole(blocks: RowBlocks, spec: BoostSpec, models: Sequence[int], written_every: int) -> list[tuple[int, int, int, bytes]]:
    """The trees of every model, each model grown by one task."""
    places, width, edges, counts = blocks.places, blocks.width, blocks.edges, {m: blocks.classes[m] for m in models}
    codes, models = np.array([len(e) + 1 for e in edges], np.int64), list(models)

    def seen(r) -> Iterator[tuple[int, KeptBlock]]:
        by_row, labels = np.frombuffer(r["codes"], np.uint8).reshape(-1, width), np.frombuffer(r["labels"], np.uint8)
        members, place = np.frombuffer(r["members"], np.int64), places[r["part"], r["seq"]]
        for i, m in enumerate(models):
            rows = np.flatnonzero(members >> m & 1)
            if len(rows):
                yield i, KeptBlock([(place, len(rows))], np.ascontiguousarray(by_row[rows].T), labels[rows], members[rows], np.zeros((0, len(rows))))

    def grown(part: Iterator[tuple[int, KeptBlock]]) -> Iterator[tuple[int, int, int, bytes]]:
        held: dict[int, list[KeptBlock]] = {}
        for i, block in part:
            held.setdefault(models[i], []).append(block)
        cut_of = cutter(edges)
        for m, some in held.items():
            run = _WholeModel(m, merged(sorted(some, key=lambda b: b.place)), spec, codes, class_weight(counts[m]), written_every)
            some.clear()
            for number in range(spec.rounds):
                yield m, number, -1, run.tree(number).nodes(cut_of).tobytes()

    found = blocks.table.rdd.flatMap(seen).partitionBy(len(models), lambda i: i).mapPartitions(grown).collect()
    there = {m for m, _, _, _ in found}
    # a model without rows has trees of one leaf
    return found + [(m, number, -1, CodedTree().nodes(cutter(edges)).tobytes()) for m in models if m not in there for number in range(spec.rounds)]


def _table(spark: SparkSession, rows: list[tuple], name: str) -> DataFrame:
    """Trees of bounded depth, some kilobytes each, as a table in the shared folder."""
    path = scratch_path(spark, name)
    spark.createDataFrame(rows, TREES).coalesce(1).write.parquet(path)
    return spark.read.schema(TREES).parquet(path)


@dataclass(frozen=True)
class StumpSpec:
    rounds: int


def with_stumps(block: KeptBlock, stumps: dict[int, tuple[int, int, int, int, float, float]]) -> KeptBlock:
    """The rows' weights after one more stump (feature, code, vote left, vote right, factor if right, factor if wrong) a model."""
    state = block.state.copy()
    for i, (feature, code, low, high, kept, raised) in stumps.items():
        vote = np.where(block.by_feature[feature] <= code, low, high)
        state[i] *= np.where(vote == block.labels, kept, raised)
    return replace(block, state=state)


def grow_stumps(blocks: RowBlocks, spec: StumpSpec, models: Sequence[int]) -> tuple[DataFrame, dict[int, list[float]]]:
    """The stumps of every model as rows of ``TREES`` (votes -1 and 1), and the weight of each.

    A round is one histogram of weighted class sums over (feature, code) and no pass else: the rows are kept with their
    weights, which each stump changes once. A model ends early when a stump is perfect or no better than chance.
    """
    spark, bins, width, models = blocks.spark, max([1, *map(len, blocks.edges)]) + 1, blocks.width, list(models)
    kept = _KeptRows(blocks, lambda n: np.ones((len(models), n)))
    weights: dict[int, list[float]] = {m: [] for m in models}
    live, rows, cut_of = list(models), [], cutter(blocks.edges)
    for number in range(spec.rounds):
        if not live:
            break
        now = list(live)

        def summed(part: Iterator[KeptBlock]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
            held: dict[int, np.ndarray] = {}
            first = -1
            for block in part:
                first = block.place if first < 0 else first
                places = [by_label(codes, block.labels) for codes in block.by_feature]
                for m in now:
                    weight = block.state[models.index(m)] * (block.members >> m & 1)
                    total = held.setdefault(m, np.zeros((width, bins, 2)))
                    for f, place in enumerate(places):
                        total[f] += np.bincount(place, weight, bins * 2).reshape(bins, 2)
            yield from ((now.index(m), (first, total)) for m, total in held.items())

        def best(parts: Iterator[tuple[int, tuple[int, np.ndarray]]]) -> Iterator[tuple]:
            found: dict[int, list] = {}
            for i, what in parts:
                found.setdefault(i, []).append(what)
            for i, some in found.items():
                total = np.zeros((width, bins, 2))
                for _, part in sorted(some, key=lambda x: x[0]):
                    total += part
                gain, feature, code, left = weighted_stump(total)
                yield now[i], gain, feature, code, left.tolist(), (total[feature].sum(axis=0) - left).tolist()

        dealt, made = kept.now.mapPartitions(summed).partitionBy(len(now), lambda i: i), {}
        for m, gain, feature, code, left, right in sorted(dealt.mapPartitions(best).collect()):
            low, high = int(left[1] > left[0]), int(right[1] > right[0])
            error = (min(left) + min(right)) / (left[0] + left[1] + right[0] + right[1])
            if not np.isfinite(gain) or error >= 0.5:
                if not weights[m]:
                    raise ValueError("a single stump is no better than chance on these rows")
                live.remove(m)
                continue
            nodes = np.zeros(3, NODE)
            nodes["feature"], nodes["value"] = [feature, -1, -1], [0.0, 2 * low - 1, 2 * high - 1]
            nodes["left"][0], nodes["right"][0], nodes["gain"][0] = 1, 2, gain
            nodes["cut"][0] = cut_of(np.array([feature]), np.array([code]))[0]
            rows.append((m, number, -1, nodes.tobytes()))
            weights[m].append(float(np.log((1 - error) / error)) if error > 0 else 1.0)
            if error <= 0:
                live.remove(m)
                continue
            # wrong rows gain, right ones lose, and the total weight stays the same
            made[models.index(m)] = (feature, code, low, high, 1 / (2 * (1 - error)), 1 / (2 * error))
        if live and number + 1 < spec.rounds:
            kept.advance(partial(with_stumps, stumps=made), (number + 1) % WRITTEN_EVERY == 0)
    kept.release()
    return _table(spark, rows, "stumps"), weights


def by_label(codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The place of each row among (code, class)."""
    return codes.astype(np.int64) * 2 + labels


def weighted_stump(total: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature, code and left class weights of the best split of (features x codes x classes); the first among equals."""
    left = np.cumsum(total, axis=1)
    gains = split_gains(left, np.maximum(left[:, -1:, :] - left, 0), np.ones(2))
    # sums of floats: what is left of a side without rows is rounding
    filled = np.cumsum((total > 0).any(axis=2), axis=1)
    gains = np.where((filled > 0) & (filled < filled[:, -1:]), gains, -np.inf)
    feature, code = np.unravel_index(gains.argmax(), gains.shape)
    return float(gains[feature, code]), int(feature), int(code), left[feature, code]
