"""Character models against a direct Kneser-Ney computation; languages on held-out texts; edge rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm.kneser_ney import CharModel, fit_model, symbol_stream
from riskweave.llm.language_id import fit_languages, with_languages
from riskweave.llm.queries import LLM_QUERIES


def stream_of(text, order):
    kept = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    return " " * (order - 1) + " ".join(kept) + " " if kept else ""


def brute_counts(texts, order):
    return Counter(s[i - order + 1 : i + 1] for s in (stream_of(t, order) for t in texts) for i in range(order - 1, len(s)))


def brute_logs(tables, order, own_from, stream, label):
    """Interpolated Kneser-Ney log probabilities from the definition."""
    every = Counter()
    for t in tables:
        every.update(dict.fromkeys(t, 1))
    floor = 1 / (len({c for g in every for c in g}) + 2)
    levels, above, pooled = [tables[label]], set(tables[label]), set(every)
    for length in range(order - 1, 0, -1):
        source = above if length >= own_from else pooled
        level = Counter(g[1:] for g in source)
        levels.append(level)
        above, pooled = {g[1:] for g in above}, {g[1:] for g in pooled}
    stats = []
    for level in levels:
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in level.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats.append((level, min(0.95, max(0.1, ones / max(ones + 2 * twos, 1))), total, kinds))

    def p(gram):
        if not gram:
            return floor
        level, d, total, kinds = stats[order - len(gram)]
        lower = p(gram[1:])
        h = gram[:-1]
        return max(level[gram] - d, 0) / total[h] + d * kinds[h] / total[h] * lower if total.get(h) else lower

    return [math.log(p(stream[i - order + 1 : i + 1])) for i in range(order - 1, len(stream))]


@pytest.mark.parametrize("order,own_from", [(3, 1), (4, 3), (1, 1)])
def test_model_equals_definition(spark, order, own_from):
    texts = [["The cat sat. The hat!", "a  cat's tea"], ["der Hut", "über die Katze, über", ""]]
    rows = spark.createDataFrame([(k, t) for k, ts in enumerate(texts) for t in ts], "label int, text string")
    model = fit_model(spark, rows, 2, order, own_from)
    tables = [brute_counts(ts, order) for ts in texts]
    for text in ["the katze", "Ünd über 12 xyz", "zzz", "", "...", "cat"]:
        raw = text.encode()
        symbols, at, edges, letters = symbol_stream(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), order)
        logs = model.position_logs(symbols, at)
        stream = stream_of(text, order)
        assert len(at) == max(0, len(stream) - order + 1) and letters[0] == sum(c.isalpha() for c in text)
        for label in (0, 1):
            expected = brute_logs(tables, order, own_from, stream, label) if stream else []
            assert np.allclose(logs[:, label], expected, atol=1e-4)


def test_rows_do_not_touch():
    raw = [b"ab c", b"", b"  D.", b"12", "é".encode(), b"x"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    symbols, at, edges, letters = symbol_stream(data, offsets, 3)
    rows = ["".join(chr(symbols[i]) for i in at[a:b]) for a, b in zip(edges, edges[1:])]
    assert rows == ["ab c ", "", "d ", "", "é ", "x "] and letters.tolist() == [3, 0, 1, 0, 1, 1]
    assert all(symbols[at[a] - 1] == symbols[at[a] - 2] == 32 for a, b in zip(edges, edges[1:]) if a < b)


def test_empty_model_is_uniform():
    model = CharModel([], np.zeros(0, int), np.zeros(0), 2, 2)
    symbols, at, *_ = symbol_stream(np.frombuffer(b"ab", np.uint8), np.array([0, 2]), 2)
    assert np.allclose(model.position_logs(symbols, at), -math.log(2))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = LLM_QUERIES["op1_language_id"](spark, sf_dir).join(docs, "doc_id").filter("held_out and text is not null").toPandas()
    assert len(out) > 20 and (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and out["rejected"].mean() < 0.05


def test_edge_rows(spark):
    english = [(i, f"the house and the river number {'one two three four five'.split()[i % 5]}", "en", "r") for i in range(60)]
    german = [(100 + i, f"das Haus und der Fluss über {'eins zwei drei vier'.split()[i % 4]}", "de", "r") for i in range(60)]
    rows = english + german + [(None, "the house", None, None), (500, None, "en", ""), (501, "12 ...", "xx", ""), (502, "", "de", ""),
                               (503, "das Haus " * 30_000, None, ""), (503, "das Haus " * 30_000, None, ""), (504, "Ω≈ç√∫ жзй 漢字かな", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("LANG_PRED", F.lit(1))
    found = fit_languages(spark, docs, F.col("doc_id") < 500)
    out = {(r.doc_id, r.text): r for r in with_languages(spark, docs, found).collect()}
    assert with_languages(spark, docs, found).count() == len(rows)
    assert out[None, "the house"].lang_pred == "en" and out[503, "das Haus " * 30_000].lang_pred == "de"
    for key in ((500, None), (501, "12 ..."), (502, "")):
        assert out[key].lang_pred == "und" and out[key].score == 0 and out[key].rejected
    assert out[504, "Ω≈ç√∫ жзй 漢字かな"].rejected
    assert fit_languages(spark, docs, F.lit(False)) is None
    assert {r.lang_pred for r in with_languages(spark, docs, None, keep_text=False).collect()} == {"und"}
    assert with_languages(spark, docs.filter("false"), found).count() == 0


def test_large_class_leaves_a_small_one_its_counts(spark):
    symbols = np.random.default_rng(3).integers(0x4E00, 0x9F00, 650_000)
    texts = [["".join(map(chr, symbols))], ["small river house"]]
    rows = spark.createDataFrame([(k, t) for k, ts in enumerate(texts) for t in ts], "label int, text string")
    model = fit_model(spark, rows, 2, 2)
    tables = [brute_counts(ts, 2) for ts in texts]
    assert len(model.grams[-1].keys) - 1 == len({*tables[0], *tables[1]}) > 600_000
    symbols, at, *_ = symbol_stream(np.frombuffer(b"small house", np.uint8), np.array([0, 11]), 2)
    logs = model.position_logs(symbols, at)
    for label in (0, 1):
        assert np.allclose(logs[:, label], brute_logs(tables, 2, 1, stream_of("small house", 2), label), atol=1e-4)
