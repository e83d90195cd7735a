"""Line links and removals against SQL and brute force."""

import random

import numpy as np
import pytest
from check_oracle import difference, oracle_connection
from pyspark.sql import functions as F

from riskweave.llm import line_dedup
from riskweave.llm.line_dedup import line_report, lines_removed
from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES


def brute(rows, percent):
    """rows: (id, text); the numbers of the later lines by text, and the links of each line."""
    lines = []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(line.encode().lower().split())
            if words:
                lines.append(((i if i is not None else 1 << 62, n), text, words))
    sets = {w for *_, w in lines}
    linked = {a: {b for b in sets if a != b and len(a & b) * 100 >= percent * len(a | b)} for a in sets}
    first = {}
    for place, _, words in lines:
        first[words] = min(first.get(words, place), place)
    later = {}
    for place, text, words in lines:
        if min(first[x] for x in linked[words] | {words}) < place:
            later.setdefault((place[0], text), set()).add(place[1])
    return later, linked


def test_query_equals_sql(spark, sf_dir):
    ours = LLM_QUERIES["op5_line_dedup"](spark, sf_dir).toPandas()
    assert difference(ours, oracle_connection(sf_dir).execute(LLM_ORACLES["op5_line_dedup"]).df()) is None
    assert ours["n_removed"].sum() > 0 and ours["n_links"].sum() > 0


@pytest.mark.parametrize("percent,limit", [(50, 512), (50, 3), (80, 512), (80, 3), (90, 2), (100, 512)])
def test_random_lines_equal_brute_force(spark, percent, limit, monkeypatch):
    real = line_dedup.later_lines
    monkeypatch.setattr(line_dedup, "later_lines", lambda *given: real(*given, limit=limit))
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 40
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    for _ in range(120):
        words = rng.choice(lines).split()
        for _ in range(rng.randrange(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(rng.choice(["", "  "]).join(["", " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)]))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[6 * i : 6 * i + 6])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    later, linked = brute(rows, percent)
    out = {r.doc_id: r for r in line_report(spark, docs, percent).collect()}
    for i, text in rows:
        sets = [s for s in (frozenset(line.encode().lower().split()) for line in text.split("\n")) if s]
        assert out[i].removed_lines == sorted(later.get((i, text), []))
        assert out[i].n_lines == len(sets) and out[i].n_links == sum(len(linked[s]) for s in sets)


@pytest.mark.parametrize("classes,limit", [(4, 4096), (4, 5), (2048, 5)])
def test_large_groups_in_cells_equal_brute_force(spark, monkeypatch, classes, limit):
    monkeypatch.setattr(line_dedup, "GROUP_CLASSES", classes)
    monkeypatch.setattr(line_dedup, "BUCKET_ENTRIES", 40)
    real = line_dedup.later_lines
    monkeypatch.setattr(line_dedup, "later_lines", lambda *given: real(*given, limit=limit))
    rng = random.Random(classes + limit)
    template = [f"common{i}" for i in range(14)]
    lines = []
    for _ in range(160):
        words = list(template)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(14)] = f"own{rng.randrange(40)}"
        lines.append(" ".join(words))
    rows = [(i, "\n".join(lines[8 * i : 8 * i + 8])) for i in range(20)]
    later, linked = brute(rows, 80)
    out = {r.doc_id: r for r in line_report(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 80).collect()}
    assert {i: out[i].removed_lines for i, _ in rows} == {i: sorted(later.get((i, t), [])) for i, t in rows}
    assert {i: out[i].n_links for i, _ in rows} == {i: sum(len(linked[frozenset(x.encode().split())]) for x in t.split("\n")) for i, t in rows}


def test_linked_sets():
    rng = random.Random(9)
    sets = [np.array(rng.sample(range(60), rng.randrange(1, 25)), np.int64) for _ in range(40)] + [np.array([5], np.int64), np.array([5, 6], np.int64)]
    for percent in (50, 80, 100):
        found = line_dedup.linked_sets(sets, percent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                alike = len({*a} & {*b}) * 100 >= percent * len({*a} | {*b})
                assert found[i, j] == (alike and i != j)


def test_places_of_lines_beside_empty_texts_and_line_ends(spark):
    near = [f"alpha beta gamma delta epsilon zeta eta theta iota {w}" for w in ("one", "two", "three")]
    texts = ["", None, f"{near[0]}\n", "\n", f"\n{near[1]}\n\n", "", f"other\n\n{near[2]}", None, f"{near[0]}\nx y z\n"]
    rows = list(enumerate(texts))
    later, linked = brute(rows, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in line_report(spark, docs, 80).collect()}
    assert {i: out[i].removed_lines for i, _ in rows} == {i: sorted(later.get((i, t), [])) for i, t in rows}
    assert out[8].n_links == 2 and out[4].n_links == 2 and sum(map(len, linked.values())) == 6


def test_long_lines_with_wide_signs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(300)]
    base = [rng.sample(words, rng.randrange(30, 120)) for _ in range(12)]
    lines = [" ".join(b if rng.random() > share else rng.choice(words) for b in rng.choice(base)) for share in (0.0, 0.05, 0.08, 0.11, 0.14) for _ in range(24)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(30)]
    later, linked = brute(rows, 80)
    out = {r.doc_id: r for r in line_report(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 80).collect()}
    assert {i: out[i].removed_lines for i, _ in rows} == {i: sorted(later.get((i, t), [])) for i, t in rows}
    assert sum(r.n_links for r in out.values()) == sum(len(linked[frozenset(line.encode().split())]) for line in lines) > 50


def test_edge_rows(spark):
    long_text = "\n".join(f"line number {i} of a very long text" for i in range(20_000))
    rows = [(1, "One two\nthree", "x"), (1, "other\nONE  two", "y"), (2, None, "z"), (3, "", "z"), (4, "\n \n", "z"), (None, "three\nnew", None),
            (5, "two one one\nfive\r", "a"), (5, "two one one\nfive\r", "a"), (6, "one two\nthree", "gone"), (7, long_text, "long"), (8, "é\x00 ü\né\x00 ü", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("N_LINES", F.lit(0)).withColumn("th", F.lit("t"))
    assert line_report(spark, docs).count() == len(rows)
    out = sorted(((r.doc_id, r.text, r.id) for r in lines_removed(spark, docs.drop("N_LINES")).filter("doc_id != 7 or doc_id is null").collect()), key=str)
    assert out == sorted([(1, "One two\nthree", "x"), (1, "other", "y"), (2, None, "z"), (3, "", "z"), (4, "\n \n", "z"), (None, "new", None),
                          (5, "five\r", "a"), (5, "five\r", "a"), (8, "é\x00 ü", "b")], key=str)
    assert line_report(spark, docs.filter("false")).count() == 0 and lines_removed(spark, docs.filter("false")).count() == 0
