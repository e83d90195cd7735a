"""Toxicity on held-out labels; edge rows."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm.flat import text_buffers
from riskweave.llm.kneser_ney import CharModel
from riskweave.llm.queries import LLM_QUERIES
from riskweave.llm.toxicity import ORDER, fit_toxicity, likelihood_differences, with_toxicity


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    everything = LLM_QUERIES["op6_toxicity"](spark, sf_dir).toPandas()
    assert len(everything) == 1000 and everything["score"].between(0, 1).all()
    assert ((everything["score"] >= 0.5) == (everything["predicted"] == 1)).all()
    out = everything.merge(labels.toPandas(), on="doc_id").query("held_out")
    toxic, clean = out[out["toxic"] == 1]["score"], out[out["toxic"] == 0]["score"]
    better = sum((t > clean).sum() + (t == clean).sum() / 2 for t in toxic) / (len(toxic) * len(clean))
    assert better > 0.85 and (clean >= 0.5).mean() < 0.1


def test_edge_rows(spark):
    rows = [(i, f"a calm {'walk talk song tale'.split()[i % 4]} by the river {'today now then'.split()[i % 3]}", 0) for i in range(120)]
    rows += [(1000 + i, f"a vile {'walk talk song tale'.split()[i % 4]} by the scumbag {'today now then'.split()[i % 3]}", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(2000, None, 1), (2001, "", 1), (None, "the scumbag", 1), (2002, "vile scumbag " * 20_000, 1)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (2000, 1), (None, 1), (7, 5), (9999, 1)], "doc_id long, toxic int")
    found = fit_toxicity(spark, docs, labels, F.lit(True))
    out = {r.doc_id: r for r in with_toxicity(spark, docs, found).collect()}
    assert out[None].predicted == 1 and out[2002].predicted == 1 and out[2000].predicted == 0 and out[2001].predicted == 0
    assert sum(out[i].predicted == y for i, _, y in rows) >= 178
    assert fit_toxicity(spark, docs, labels.filter("toxic = 0"), F.lit(True)) is None
    assert {r.score for r in with_toxicity(spark, docs, None).collect()} == {0.0}
    assert with_toxicity(spark, docs.filter("false"), found).count() == 0


def direct_model(texts, order):
    """Interpolated Kneser-Ney of one class as a function of history and symbol, from dictionaries; also its alphabet."""
    grams = Counter()
    for text in texts:
        stream = " " * (order - 1) + text
        grams.update(stream[i : i + order] for i in range(len(text)))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    return levels


def direct_log(levels, order, floor, history, symbol):
    p = floor
    for n in range(1, order + 1):
        counts = levels[n]
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        context = history[len(history) - n + 1 :]
        after = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
        total = sum(after.values())
        if total:
            p = max(after.get(symbol, 0) - discount, 0) / total + discount * len(after) / total * p
    return math.log(p)


def normal(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return " ".join(words) + " " if words else ""


def test_features_and_score_equal_a_direct_version():
    toxic = ["you vile scum", "vile vile person, scum!", "what a scum"]
    clean = ["a calm river", "calm people walk", "what a river, what a walk", "you calm person"]
    grams = Counter()
    for label, texts in enumerate((clean, toxic)):
        for text in map(normal, texts):
            stream = " " * (ORDER - 1) + text
            grams.update((stream[i : i + ORDER], label) for i in range(len(text)))
    keys = list(grams)
    model = CharModel([g for g, _ in keys], np.array([k for _, k in keys]), np.array([grams[x] for x in keys], float), 2, ORDER, pooled=True)
    own = [direct_model(map(normal, t), ORDER) for t in (clean, toxic)]
    own.append(direct_model(map(normal, clean + toxic), ORDER))
    # continuation counts of the pooled model are those of its own n-grams, not sums over classes
    floor = 1 / (len({c for g, _ in keys for c in g}) + 2)
    texts = ["vile river scum", "calm", "unseen zebra", "", "...", "vile scum " * 5]
    data, offsets = text_buffers(pa.array(texts))
    shares = [0.05, 0.6]
    found = likelihood_differences(model, data, offsets, shares)
    for share, features in zip(shares, found):
        for text, row in zip(texts, features):
            symbols = normal(text)
            logs = []
            for i, c in enumerate(symbols):
                history = (" " * ORDER + symbols[:i])[-ORDER:]
                p = [math.exp(direct_log(levels, ORDER, floor, history, c)) for levels in own]
                logs.append([math.log((1 - share) * q + share * p[2]) for q in p[:2]])
            leads = [b - a for a, b in logs]
            words, at = [], 0
            for word in symbols.split(" ")[:-1]:
                words.append(leads[at : at + len(word) + 1])
                at += len(word) + 1
            expected = [sum(leads) / max(len(leads), 1), max((sum(w) / len(w) for w in words), default=0.0), max(map(sum, words), default=0.0),
                        *[sum(x[k] for x in logs) for k in (0, 1)]]
            assert row.tolist() == pytest.approx(expected, abs=1e-3)
    # words of one class only, in contexts that no class has seen: the lead has the sign of their class
    mixed = ["zebra vile zebra", "zebra calm zebra", "scum scum river scum scum", "river calm scum calm walk river"]
    lead = likelihood_differences(model, *text_buffers(pa.array(mixed)), [0.02])[0]
    assert lead[0, 2] > 0.5 and lead[2, 0] > 0 and lead[3, 0] < 0 and lead[1, 0] < lead[0, 0]


def test_score_is_the_logistic_decision(spark):
    rows = [(i, f"a calm walk by the river number {'one two three four five'.split()[i % 5]}", 0) for i in range(80)]
    rows += [(100 + i, f"a vile scumbag by the river {'one two three four five'.split()[i % 5]}", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = fit_toxicity(spark, docs, labels, F.lit(True))
    text_share, word_share = found.pooled_shares
    data, offsets = text_buffers(pa.array([t for _, t, _ in rows]))
    whole, words = (likelihood_differences(found.model, data, offsets, [s])[0] for s in (text_share, word_share))
    expected = {}
    for i, (doc_id, _, _) in enumerate(rows):
        x = [whole[i, 0], words[i, 1], words[i, 2]]
        z = found.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(found.weights[1:], x, found.centre, found.scale))
        expected[doc_id] = 1 / (1 + math.exp(-z))
    assert {r.doc_id: r.score for r in with_toxicity(spark, docs, found).collect()} == pytest.approx(expected, abs=1e-9)
    assert (found.weights[1:] >= 0).all()
