"""Forests, boosted trees and stumps against direct NumPy versions; where a node is finished changes nothing."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import tree_boosting
from riskweave.operators.exact_tree import ExactTree, open_ranges
from riskweave.operators.row_blocks import leaving_out, row_blocks
from riskweave.operators.tree_boosting import SCALE, BoostSpec, StumpSpec, grow_boosted, grow_stumps
from riskweave.operators.tree_growth import Drawing, ForestSpec, counted_splits, grow_forest, rows_by_node, scanned_splits, split_gains, whole_tree
from riskweave.operators.tree_models import BoostedStumps, ForestClassifier, NewtonBoosting, TreeEnsemble
from riskweave.session import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    """500 rows with ties, a feature of two values, a constant one, and folds."""
    rng = np.random.RandomState(3)
    x = np.column_stack([rng.normal(size=500).round(1), rng.randint(0, 2, 500), rng.randint(0, 40, 500), np.ones(500), rng.normal(size=500)])
    y = ((x[:, 0] + x[:, 2] / 20 + rng.normal(size=500) * 0.8) > 0.9).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label int, fold int").repartition(4, "id")
    return df.withColumn("features", array_to_vector("x")).cache(), x, y


@pytest.fixture(scope="module")
def blocks(data):
    return row_blocks(data[0], "features", "label", leaving_out("fold", 3), 4, bins=16, block_rows=70)


def trees_of(table):
    """Whole trees by (model, tree)."""
    found = {}
    for r in table.collect():
        found.setdefault((r["model"], r["tree"]), {})[r["node"]] = bytes(r["nodes"])
    return {k: whole_tree(pieces.pop(-1), pieces) for k, pieces in found.items()}


def shape(nodes, at=0):
    """A tree as nested tuples, whatever the order of its nodes."""
    n = nodes[at]
    if n["feature"] < 0:
        return round(float(n["value"]), 12)
    return int(n["feature"]), float(n["cut"]), round(float(n["gain"]), 9), shape(nodes, n["left"]), shape(nodes, n["right"])


def coded(edges, x):
    return np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])


def direct_cart(codes, y, w, edges, weights):
    """Best Gini split of every feature and code, node by node, the first among equals."""
    c = np.array([w[y == 0].sum(), w[y == 1].sum()]) * weights
    pure = lambda v: (v * v).sum() / v.sum()
    best = (-1.0,)
    if (c > 0).all():
        for f in range(codes.shape[1]):
            for cut in range(len(edges[f])):
                go = codes[:, f] <= cut
                left = np.array([w[go & (y == k)].sum() for k in (0, 1)]) * weights
                if left.sum() > 0 and (c - left).sum() > 1e-9:
                    gain = pure(left) + pure(c - left) - pure(c)
                    if gain > best[0] + 1e-12:
                        best = gain, f, cut
    if len(best) == 1:
        return round(c[1] / c.sum(), 12)
    gain, f, cut = best
    go = codes[:, f] <= cut
    sides = [direct_cart(codes[s], y[s], w[s], edges, weights) for s in (go, ~go)]
    return f, float(edges[f][cut]), round(gain, 9), *sides


def close(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return a == pytest.approx(b, abs=1e-9)
    return a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6) and close(a[3], b[3]) and close(a[4], b[4])


@pytest.mark.parametrize("local_rows", [10_000, 40])
@pytest.mark.parametrize("balanced", [False, True])
def test_tree_equals_direct_version(data, blocks, local_rows, balanced):
    _, x, y = data
    spec = ForestSpec(1, balanced=balanced)
    grown = trees_of(grow_forest(blocks, spec, [0, 2], local_rows))
    for model in (0, 2):
        rows = np.arange(500) % 3 + 1 != model
        n = np.bincount(y[rows])
        weights = rows.sum() / (2 * n) if balanced else np.ones(2)
        expected = direct_cart(coded(blocks.edges, x[rows]), y[rows], np.ones(rows.sum()), blocks.edges, weights)
        assert close(shape(grown[model, 0]), expected)


def test_where_a_node_is_finished_changes_nothing(blocks, monkeypatch):
    spec = ForestSpec(6, per_tree=4, per_node=2, share=1.0, balanced=True)
    one, other = (trees_of(grow_forest(blocks, spec, [0, 1], n)) for n in (10_000, 25))
    monkeypatch.setattr("riskweave.operators.tree_growth.HISTOGRAM_BYTES", 2_000)
    monkeypatch.setattr("riskweave.operators.tree_growth.SHUFFLED_BYTES", 30_000)
    third = trees_of(grow_forest(blocks, spec, [0, 1], 60))
    assert set(one) == {(m, t) for m in (0, 1) for t in range(6)}
    for key in one:
        assert shape(one[key]) == shape(other[key]) == shape(third[key])
    assert len({shape(t) for t in one.values()}) == 12


@pytest.mark.parametrize("share", [0.8, 1.0])
def test_draws_have_an_exact_size_and_repeat(blocks, share):
    rows = blocks.table.toArrow()
    read = blocks.reader()
    for model in (0, 2):
        again = []
        for _ in range(2):
            drawing = Drawing(blocks.sizes, ForestSpec(3, share=share))
            counts = [[drawing.counts(b, model, t) for t in range(3)] for b in read(iter(rows.to_batches()))]
            again.append(counts)
            n = 500 if not model else (np.arange(500) % 3 + 1 != model).sum()
            assert [sum(int(c[t].sum()) for c in counts) for t in range(3)] == [round(share * n)] * 3
            assert all((c[0][b.members >> model & 1 == 0] == 0).all() for c, b in zip(counts, read(iter(rows.to_batches()))))
        assert all((a[t] == b[t]).all() for a, b in zip(*again) for t in range(3))
        assert max(int(c[0].max()) for c in again[0]) > 1


def direct_boosting(codes, y, edges, rounds, depth, step, weight):
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1.0)
        g, h = np.rint(w * (p - y) * SCALE) / SCALE, np.rint(w * np.maximum(p * (1 - p), 1e-16) * SCALE) / SCALE

        def grow(rows, level, g=g, h=h, margin=margin):
            total = g[rows].sum(), h[rows].sum()
            best = (1e-6,)
            if level < depth:
                for f in range(codes.shape[1]):
                    for cut in range(len(edges[f])):
                        go = rows[codes[rows, f] <= cut]
                        gl, hl = g[go].sum(), h[go].sum()
                        gr, hr = total[0] - gl, total[1] - hl
                        if 0 < len(go) < len(rows) and hl >= 1 and hr >= 1:
                            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total[0] ** 2 / (total[1] + 1)
                            if gain > best[0] + 1e-11:
                                best = gain, f, cut
            if len(best) == 1:
                value = -total[0] / (total[1] + 1) * step
                margin[rows] += value
                return round(float(value), 12)
            gain, f, cut = best
            go = codes[rows, f] <= cut
            return f, float(edges[f][cut]), round(float(gain), 9), grow(rows[go], level + 1), grow(rows[~go], level + 1)

        trees.append(grow(np.arange(len(y)), 0))
    return trees


@pytest.mark.parametrize("local_rows", [10_000, 60, 0])
def test_boosting_equals_direct_version(data, blocks, local_rows):
    _, x, y = data
    spec = BoostSpec(6, step=0.3, depth=3, row_share=1.0, feature_share=1.0)
    grown = trees_of(grow_boosted(blocks, spec, [0, 3], local_rows, written_every=2))
    for model in (0, 3):
        rows = np.arange(500) % 3 + 1 != model
        n = np.bincount(y[rows])
        expected = direct_boosting(coded(blocks.edges, x[rows]), y[rows], blocks.edges, 6, 3, 0.3, n[0] / n[1])
        assert all(close(shape(grown[model, i]), tree) for i, tree in enumerate(expected))


def test_sampled_boosting_is_the_same_whatever_is_written(blocks):
    spec = BoostSpec(5, depth=3, row_share=0.7, feature_share=0.6)
    one, other = (trees_of(grow_boosted(blocks, spec, [0, 1], *how)) for how in ((10_000, 100), (50, 1)))
    assert all(shape(one[k]) == shape(other[k]) for k in one) and len(one) == 10


def test_driver_and_tasks_add_up_the_same_trees(blocks, monkeypatch):
    spec = BoostSpec(4, depth=4, row_share=0.7, feature_share=0.6)
    with monkeypatch.context() as m:
        m.setattr(tree_boosting._Boosting, "_pass", lambda *_: pytest.fail("a pass of small histograms had a second stage"))
        on_driver = trees_of(grow_boosted(blocks, spec, [0, 1], 0, written_every=2))
    monkeypatch.setattr(tree_boosting, "DRIVER_BYTES", 0)
    in_tasks = trees_of(grow_boosted(blocks, spec, [0, 1], 0, written_every=2))
    assert len(on_driver) == 8 and all(shape(on_driver[k]) == shape(in_tasks[k]) for k in on_driver)
    assert any(len(tree) > 7 for tree in on_driver.values())  # some nodes were what remained of their parents


def test_best_splits_of_cells_equal_those_of_histograms():
    rng = np.random.default_rng(5)
    lengths, spec = np.array([3, 1, 6, 2]), BoostSpec(1, least_weight=0.0)
    starts = np.append(0, np.cumsum(lengths))
    sums = np.zeros((5, 12, 3), np.int64)
    for node in range(4):  # the last node is empty
        for a, b in zip(starts, starts[1:]):
            rows = rng.integers(0, b - a, 40)
            for k, values in enumerate((np.arange(40) * 1000 * node - 9_000_000, np.full(40, SCALE // 5), None)):
                sums[node, a:b, k] = np.bincount(rows, values, b - a)
    gains, cells, lefts, wholes = tree_boosting.best_cell_splits(sums, starts, spec)
    for node in range(5):
        dense = np.zeros((4, 6, 3), np.int64)
        for slot, (a, b) in enumerate(zip(starts, starts[1:])):
            dense[slot, : b - a] = sums[node, a:b]
        gain, slot, code, left = tree_boosting.best_newton_split(dense, spec)
        assert gains[node] == gain and (wholes[node] == dense[0].sum(axis=0)).all()
        if np.isfinite(gain):
            assert cells[node] == starts[slot] + code and (lefts[node] == left).all()


def test_merged_blocks_draw_the_same_rows():
    rng = np.random.default_rng(6)
    each = [
        tree_boosting.KeptBlock([(i, n)], rng.integers(0, 9, (3, n)).astype(np.uint8), np.zeros(n, np.uint8), rng.integers(0, 4, n), np.zeros((2, 2, n)))
        for i, n in enumerate((50, 70, 30))
    ]
    found = list(tree_boosting.gathered(iter(each), 120))
    assert [b.parts for b in found] == [[(0, 50), (1, 70)], [(2, 30)]]
    for model in (0, 1):
        apart = np.concatenate([each[0].drawn(model, 7, 0.6), each[1].drawn(model, 7, 0.6) + 50])
        assert found[0].drawn(model, 7, 0.6).tolist() == apart.tolist()


def test_stumps_equal_direct_samme(data, blocks):
    _, x, y = data
    table, weights = grow_stumps(blocks, StumpSpec(8), [0, 2])
    grown = trees_of(table)
    for model in (0, 2):
        rows = np.arange(500) % 3 + 1 != model
        codes, truth = coded(blocks.edges, x[rows]), y[rows]
        w = np.ones(len(truth)) / len(truth)
        for i in range(8):
            best = (-1.0,)
            for f in range(5):
                for cut in range(len(blocks.edges[f])):
                    go = codes[:, f] <= cut
                    sides = [np.array([w[s & (truth == k)].sum() for k in (0, 1)]) for s in (go, ~go)]
                    if go.any() and not go.all():
                        value = sum((s * s).sum() / s.sum() for s in sides)
                        if value > best[0] + 1e-12:
                            best = value, f, cut, *[int(s[1] > s[0]) for s in sides]
            _, f, cut, low, high = best
            nodes = grown[model, i]
            assert (nodes["feature"][0], nodes["cut"][0]) == (f, blocks.edges[f][cut])
            assert nodes["value"][1:].tolist() == [2 * low - 1, 2 * high - 1]
            wrong = np.where(codes[:, f] <= cut, low, high) != truth
            error = w[wrong].sum() / w.sum()
            assert weights[model][i] == pytest.approx(np.log((1 - error) / error), rel=1e-9)
            w = w * np.exp(weights[model][i] * wrong)
            w /= w.sum()


def test_perfect_and_useless_stumps(spark):
    rows = spark.createDataFrame([([float(i)], int(i > 4)) for i in range(10)], "x array<double>, label int").withColumn("features", array_to_vector("x"))
    model = BoostedStumps(rounds=5).fit(rows)
    assert model.getOrDefault("weights") == [1.0]
    assert model.transform(rows).where(F.col("prediction") != F.col("label")).count() == 0
    with pytest.raises(ValueError):
        BoostedStumps(rounds=5).fit(rows.withColumn("features", array_to_vector(F.array(F.lit(1.0)))))


@pytest.mark.parametrize("estimator", [
    ForestClassifier(trees=5, seed=1, bins=16), ForestClassifier(trees=5, nodeFeatures=-1, treeFeatures=0.8, drawShare=0.8, maxDepth=4),
    NewtonBoosting(rounds=4), BoostedStumps(rounds=4),
])
def test_models_predict_round_trip_and_leave_folds_out(spark, data, estimator):
    df, x, y = data
    model = estimator.fit(df)
    rows = model.transform(df).select("id", "label", "prediction", F.col("probability").cast("string").alias("p")).orderBy("id").collect()
    assert sum(r["prediction"] == r["label"] for r in rows) > 400
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    loaded = TreeEnsemble.load(path)
    assert [r["p"] for r in loaded.transform(df).select("id", F.col("probability").cast("string").alias("p")).orderBy("id").collect()] == [r["p"] for r in rows]
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[3] == 0 and model.numFeatures == 5
    folds = estimator.fit_folds(df, "fold", 3)
    assert set(folds) == {0, 1, 2, 3}
    again = folds[0].transform(df).select("id", F.col("probability").cast("string").alias("p")).orderBy("id").collect()
    assert [r["p"] for r in again] == [r["p"] for r in rows]
    other = df.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    held = [m.transform(df).select("id", F.col("probability").cast("string").alias("p")).orderBy("id").collect()
            for m in (folds[2], estimator.fit_folds(other, "fold", 3)[2])]
    assert held[0] == held[1]
    assert model.transform(df.limit(0)).count() == 0


def test_counted_and_sorted_splits_agree():
    """Large levels of a subtree are counted and small ones sorted; the choice changes nothing, draws of 0 aside."""
    rng = np.random.RandomState(1)
    at, values, labels, draws = np.arange(900) % 7, rng.randint(0, 5, 900), rng.randint(0, 2, 900), rng.randint(1, 6, 900)
    values[at == 3] = 2  # a node that the feature does not part
    totals = np.array([[draws[(at == n) & (labels == k)].sum() for k in (0, 1)] for n in range(7)])
    weights = np.array([0.7, 1.6])
    one = counted_splits(values, at, labels, draws.astype(float), totals.astype(float), 9, weights)
    other = scanned_splits(values, at, labels, draws, totals, weights)
    assert (one[0] == other[0]).all() and np.isneginf(one[0][3])
    parted = np.isfinite(one[0])
    assert (one[1] == other[1])[parted].all() and (one[3] == other[3])[parted].all()


def test_rows_are_dealt_to_nodes_in_one_pass():
    at = np.random.RandomState(2).randint(0, 70_000, 5_000)
    for size, nodes in ((70_000, range(0, 70_000, 3)), (7, [0, 2, 5])):
        found = dict(rows_by_node(at % size, nodes, size))
        assert sorted(found) == sorted(set(nodes) & set((at % size).tolist()))
        assert all((rows == np.flatnonzero(at % size == n)).all() for n, rows in list(found.items())[:50])
    assert rows_by_node(at[:0], [1], 3) == []


def test_open_ranges_hold_the_best_split():
    """Few ranges stay open, and every value as good as the best one lies in one of them."""
    rng = np.random.RandomState(4)
    for weights in (np.ones(2), np.array([0.6, 2.5])):
        x, y = rng.normal(size=(3_000, 3)).round(2), rng.randint(0, 2, 3_000)
        y[x[:, 1] > 0.37] = 1
        cuts = [np.unique(np.quantile(x[:, f], np.arange(1, 32) / 32)) for f in range(3)]
        counts = np.zeros((3, 32, 2), np.int64)
        gains = []
        for f in range(3):
            np.add.at(counts[f], (np.searchsorted(cuts[f], x[:, f]), y), 1)
            for value in np.unique(x[:, f]):
                left = np.bincount(y[x[:, f] <= value], minlength=2)
                gains.append((split_gains(left, np.bincount(y, minlength=2) - left, weights), f, value))
        found = {(f, r): (a, b) for f, r, a, b in open_ranges(counts, weights)}
        best = max(gains)[0]
        assert len(found) <= 8
        for gain, f, value in gains:
            if gain == best:
                r = int(np.searchsorted(cuts[f], value))
                below = x[:, f] <= cuts[f][r - 1] if r else np.zeros(3_000, bool)
                assert found[f, r] == tuple(np.bincount(y[below], minlength=2))


def test_large_nodes_of_the_exact_tree_change_nothing(data):
    df, _, _ = data
    one, other = (trees_of(ExactTree(balanced=True, localRows=n).fit(df).trees.withColumn("model", F.lit(0))) for n in (10_000, 60))
    assert shape(one[0, 0]) == shape(other[0, 0])


def test_a_stump_is_applied_to_the_rows_once(blocks, monkeypatch):
    """The pass of a round does not go through the stumps before it."""
    from riskweave.operators import tree_boosting

    kept = []
    real = tree_boosting._KeptRows.advance
    monkeypatch.setattr(tree_boosting._KeptRows, "advance", lambda self, step, write: kept.append(step.keywords["stumps"]) or real(self, step, write))
    grow_stumps(blocks, StumpSpec(4), [0, 2])
    assert [len(some) for some in kept] == [2, 2, 2] and all(len(stump) == 6 for some in kept for stump in some.values())


@pytest.mark.parametrize("least", [1.0, 0.0])
def test_boosting_in_one_task_grows_the_trees_of_the_passes(blocks, monkeypatch, least):
    """A model that fits a task starts no passes, and its trees are the same."""
    spec = BoostSpec(6, step=0.3, depth=4, row_share=0.7, feature_share=0.6, least_weight=least)
    in_passes = trees_of(grow_boosted(blocks, spec, [0, 2, 3], 0, written_every=2))
    monkeypatch.setattr(tree_boosting, "_KeptRows", lambda *_: pytest.fail("a pass over rows that fit a task"))
    in_task = trees_of(grow_boosted(blocks, spec, [0, 2, 3], 0, written_every=2, whole_bytes=1 << 20))
    assert len(in_task) == 18 and in_task.keys() == in_passes.keys()
    assert all(shape(in_task[k]) == shape(in_passes[k]) for k in in_task)
    assert sum(len(tree) > 7 for tree in in_task.values()) > 10


def test_codes_counted_in_groups_give_the_sums_of_each_feature(monkeypatch):
    rng = np.random.default_rng(6)
    codes = np.array([5, 2, 9, 1, 2, 7])
    by_feature = np.stack([rng.integers(0, c, 400) for c in codes]).astype(np.uint8)
    rows, features = rng.permutation(400)[:300], np.array([0, 2, 3, 4])
    at, g, h = rng.integers(0, 3, 300), rng.integers(-(1 << 27), 1 << 27, 300), rng.integers(0, 1 << 25, 300)
    starts = np.append(0, np.cumsum(codes[features]))
    expected = tree_boosting.summed_cells(by_feature, rows, at, g, h, features, starts, 3)
    for cells in (1 << 12, 20, 1):
        monkeypatch.setattr(tree_boosting, "GROUP_CELLS", cells)
        groups = tree_boosting.cell_groups(codes)
        assert sorted(f for group in groups for f in group) == list(range(6)) and (len(groups) == 6) == (cells == 1)
        grouped = tree_boosting.grouped_codes(by_feature, codes, groups)
        assert (tree_boosting.summed_groups(grouped, groups, codes, rows, at, g, h, features, starts, 3) == expected).all()


def test_large_and_small_nodes_of_a_whole_model_are_counted_alike(monkeypatch):
    """Groups of features at a time, or one feature after the other."""
    rng = np.random.default_rng(7)
    codes, grown = np.array([4, 2, 6, 2]), []
    by_feature = np.stack([rng.integers(0, c, 3_000) for c in codes]).astype(np.uint8)
    labels = (by_feature[0] + by_feature[2] + rng.normal(size=3_000) * 2 > 4).astype(np.uint8)
    block = tree_boosting.KeptBlock([(0, 1_700), (3, 1_300)], by_feature, labels, np.ones(3_000, np.int64), np.zeros((0, 3_000)))
    for cells in (24, 1 << 14):
        monkeypatch.setattr(tree_boosting, "GROUP_CELLS", cells)
        run = tree_boosting._WholeModel(0, block, BoostSpec(4, depth=4, feature_share=0.8), codes, 1.5, 2)
        run.cells = 24 if cells == 24 else 1 << 14
        grown.append([run.tree(i) for i in range(4)])
    assert all(vars(a) | {"open": 0} == vars(b) | {"open": 0} for a, b in zip(*grown)) and len(grown[0][3].feature) > 7


def test_the_shuffle_files_of_a_batch_of_trees_go_with_it(spark, data, monkeypatch):
    from riskweave.operators import tree_growth

    blocks = row_blocks(data[0], "features", "label", leaving_out("fold", 3), 4, bins=16, block_rows=70)
    there, real = [], tree_growth._grow_batch
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b.name() for b in map(manager.getAllBlocks().apply, range(manager.getAllBlocks().size())) if b.name().startswith("shuffle_")}
    whole = trees_of(grow_forest(blocks, ForestSpec(5, share=0.8), [0, 2], 100))
    before = shuffled()

    def batch(*args):
        grown = real(*args)
        there.append((len(args[4]), len(shuffled() - before)))
        return grown

    monkeypatch.setattr(tree_growth, "_grow_batch", batch)
    monkeypatch.setattr(tree_growth, "SHUFFLED_BYTES", 500 * (blocks.width + 9) * 4)
    parts = trees_of(grow_forest(blocks, ForestSpec(5, share=0.8), [0, 2], 100))
    assert [n for n, _ in there] == [4, 4, 2] and [files for _, files in there] == [0, 0, 0]
    assert whole.keys() == parts.keys() and all(shape(whole[k]) == shape(parts[k]) for k in whole)
