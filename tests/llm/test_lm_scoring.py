"""Matching against a direct implementation; the word baseline against counting; edge rows."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from riskweave.llm.lm_scoring import text_scores
from riskweave.llm.queries import LLM_QUERIES


class DirectPpm:
    """Escape method C with symbol exclusion, from the definition; what has followed the last bytes in the text so far first."""

    def __init__(self, texts, order, own_context=3, own_weight=0.25):
        self.order, self.counts = order, defaultdict(Counter)
        self.own_context, self.own_weight = min(own_context, order), own_weight
        for text in texts:
            stream = b"\xff" * order + text.lower() + b"\xff"
            for i in range(order, len(stream)):
                for d in range(order + 1):
                    self.counts[stream[i - d : i]][stream[i]] += 1

    def log10(self, text):
        stream, whole_total, so_far = b"\xff" * self.order + text.lower() + b"\xff", 0.0, defaultdict(Counter)
        for i in range(self.order, len(stream)):
            excluded, found, total = set(), False, 0.0
            for d in range(self.order, -1, -1):
                seen = {s: c for s, c in self.counts.get(stream[i - d : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if stream[i] in seen:
                    total, found = total + math.log10(seen[stream[i]] / whole), True
                    break
                total += math.log10(len(seen) / whole)
                excluded |= set(seen)
            if not found:
                total -= math.log10(256 - len(excluded))
            own = so_far[stream[i - self.own_context : i]]
            if own:
                every = self.own_weight * sum(own.values()) + len(own)
                total = math.log10((self.own_weight * own[stream[i]] + len(own) * 10**total) / every)
            own[stream[i]] += 1
            whole_total += total
        return whole_total


def brute_base(texts, learned):
    counts = Counter(w for t in learned for w in t.lower().split())
    counts[None] = len(learned)
    n, v = sum(counts.values()), len([c for c in counts.values() if c])
    result = []
    for t in texts:
        tokens = [*t.lower().split(), None]
        result.append((len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return result


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("room", [0, 3, 1000])
def test_scores_equal_brute_force(spark, order, room):
    texts = ["The cat sat on the mat.", "the cat\tsat\nTHE END", "", None, "über die Katze", "zzz", "\x00 cat", "the the the", "mat cat " * 50]
    rows = [(i, t, i % 4 != 1) for i, t in enumerate(texts)] + [(0, texts[0], True), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("SCORE", F.lit("x"))
    raw = [(t or "").encode() for _, t, _ in rows]
    learned = [r for r, (_, _, use) in zip(raw, rows) if use]
    model = DirectPpm(learned, order)
    expected = sorted((*base, model.log10(t)) for base, t in zip(brute_base(raw, learned), raw))
    out = text_scores(spark, docs, F.col("learn"), order=order, broadcast_words=room).collect()
    ours = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out)
    for a, b in zip(ours, expected, strict=True):
        assert a == pytest.approx(b, abs=1e-6)


def test_without_training_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = text_scores(spark, docs, F.lit(False)).first()
    assert r.score == pytest.approx(-3 * math.log10(256)) and (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert text_scores(spark, docs.filter("false"), F.lit(True)).count() == 0


def test_fewer_broadcast_nodes_give_the_same_scores(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} about things {i * i}") for i in range(50)], "doc_id long, text string")
    few, all_ = ({r.doc_id: r.score for r in text_scores(spark, docs, F.lit(True), max_nodes=n).collect()} for n in (60, 10_000))
    assert few == pytest.approx(all_, abs=1e-9) and max(few.values()) < 0


@pytest.mark.parametrize("context,weight", [(1, 2.0), (2, 0.5), (4, 1.0), (3, 0.0)])
def test_adaptation_equals_direct_version(spark, context, weight):
    texts = ["banana bandana banana", "cab abacus", "", "zzzz zzzz zzzz", "b\u00e9b\u00e9 b\u00e9b\u00e9"] * 2
    rows = [(i, t, i < 3) for i, t in enumerate(texts)]
    model = DirectPpm([t.encode() for _, t, use in rows if use], 4, context, weight)
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    found = text_scores(spark, docs, F.col("learn"), order=4, max_nodes=5, own_context=context, own_weight=weight)
    assert {r.doc_id: r.score for r in found.collect()} == pytest.approx({i: model.log10(t.encode()) for i, t, _ in rows}, abs=1e-6)


def test_query_on_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    raw = {r.doc_id: (r.text or "").encode() for r in docs}
    learned = [t for i, t in raw.items() if crc32(str(i).encode()) % 7 != 2]
    expected = dict(zip(raw, brute_base(raw.values(), learned)))
    out = {r.doc_id: r for r in LLM_QUERIES["op8_lm_scoring"](spark, sf_dir).collect()}
    for i, (tokens, known, total, base) in expected.items():
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (tokens, known, total)
        assert out[i].base_score == pytest.approx(base, rel=1e-9) and out[i].held_out == (crc32(str(i).encode()) % 7 == 2)
    # on so little text most words are unknown to the baseline, which names them without spelling them: spelled byte by
    # byte, each with an end, they cost what the model pays for them
    vocabulary = {w for t in learned for w in t.lower().split()}
    spelled = sum(8 * math.log10(2) * (len(w) + 1) for i, t in raw.items() if out[i].held_out for w in t.lower().split() if w not in vocabulary)
    assert sum(r.score for r in out.values() if r.held_out) > sum(r.base_score for r in out.values() if r.held_out) - spelled


def test_better_than_the_baseline_on_more_text(spark):
    out = LLM_QUERIES["op8_lm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_adapting_helps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    learns = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    alone, adapted = (text_scores(spark, docs, learns, own_weight=w).filter(~learns).agg(F.sum("score")).first()[0] for w in (0.0, 0.25))
    assert adapted > alone * 0.95


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("nodes", [0, 20])
def test_every_context_counts_whatever_is_broadcast(spark, order, nodes):
    texts = [f"some text {i} about things {i * i}" for i in range(40)] + ["seen once: \u03a9\u03bc\u03ad\u03b3\u03b1", "seen once: \u03a9\u03bc\u03ad", "things unseen"]
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(texts)]
    model = DirectPpm([t.encode() for _, t, use in rows if use], order)
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    out = {r.doc_id: r.score for r in text_scores(spark, docs, F.col("learn"), order=order, max_nodes=nodes).collect()}
    assert out == pytest.approx({i: model.log10(t.encode()) for i, t, _ in rows}, abs=1e-6)
