"""Neighbours against SQL and brute force."""

import numpy as np
import pytest
from check_oracle import difference, oracle_connection
from pyspark.sql import functions as F

from riskweave.llm.nearest import Quantised, nearest, tile_nearest
from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES


def test_query_equals_sql(spark, sf_dir):
    ours = LLM_QUERIES["op2_nearest_neighbours"](spark, sf_dir).toPandas()
    assert difference(ours, oracle_connection(sf_dir).execute(LLM_ORACLES["op2_nearest_neighbours"]).df()) is None


@pytest.mark.parametrize("blocks", [(2, 5), (4, 40), (100, 1000)])
def test_blocks_ties_and_unusable_vectors(spark, blocks, monkeypatch):
    monkeypatch.setattr("riskweave.llm.nearest.FAN", 3)
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-3, 4, 6)] for _ in range(120)] + [[1e-3] * 6, [1e6] * 6, [5.0] * 6, [5.0] * 6]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(200, None, "n"), (220, [], "e"), (240, [0.0] * 6, "z"), (260, [1.0, None, 1.0, 1.0, 1.0, 1.0], "c"), (280, [float("nan")] + [1.0] * 5, "f"),
             (300, [float("inf")] + [1.0] * 5, "f"), (None, [1.0] * 6, "i"), (320, [1.0, 2.0], "d"), (321, [1.0, 3.0], "d"), (340, [1.0], "lone"), (3, vectors[3], "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").withColumn("id", F.lit(1))
    out = nearest(spark, table, F.col("vec_id") % 20 == 0, 7, query_block=blocks[0], candidate_block=blocks[1]).collect()
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = {}
    for q, v in usable.items():
        if q % 20 == 0:
            near = sorted((-sum((v * c).tolist()), i) for i, c in usable.items() if i != q and len(c) == len(v))[:7]
            if near:
                expected[q] = [(i, -s) for s, i in near]
    assert found == expected
    assert nearest(spark, table.filter("false"), F.lit(True)).count() == 0


def test_floor_needs_no_more_than_partition_promises(monkeypatch):
    """A partition whose other places are in descending order, as numpy allows, loses no neighbour."""

    def rough(values, kth, axis):
        values = np.sort(values, axis=axis)
        return np.concatenate([values[:, :kth][:, ::-1], values[:, kth : kth + 1], values[:, kth + 1 :][:, ::-1]], axis=1)

    rng = np.random.default_rng(2)
    queries, block = rng.normal(size=(5, 16)), rng.normal(size=(300, 16))
    query_ids, block_ids = np.arange(1000, 1005), np.arange(300)
    monkeypatch.setattr("riskweave.llm.nearest.np.partition", rough)
    for count in (1, 20, 299, 300, 400):
        found = {k: ids.tolist() for k, ids, _ in tile_nearest(Quantised(queries), query_ids, Quantised(block), block_ids, count)}
        assert found == {k: np.argsort(-(block @ queries[k]))[:count].tolist() for k in range(5)}
