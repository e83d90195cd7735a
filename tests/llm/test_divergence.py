"""The transducer against a sorted list, distances and marking terms against a direct version, edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import divergence
from riskweave.llm.divergence import Transducer, gaps, shares, source_divergence
from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES


def direct(rows, least=10, ranks=10):
    """All result rows, from (text, lang, source) with Python integers and whole dictionaries."""
    words = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in words}:
        mine = [(s, w) for l, s, w in words if l == lang]
        documents = Counter(t for _, w in mine for t in set(w))
        kept = sorted((t for t, n in documents.items() if n >= least), key=str.encode)
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(t for t in w if documents[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        for s, c in counts.items():
            found = []
            for o, d in counts.items():
                if o != s:
                    ps, qs = ([share(x, t) for t in kept] for x in (c, d))
                    found.append((-sum((p - q) ** 2 // (p + q) for p, q in zip(ps, qs)), o.encode(), o))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(found))]
            found = []
            for t in kept:
                p, q = share(c, t), share(whole, t)
                if c[t] > 0 and p > q:
                    found.append((-((p - q) ** 2 // (p + q)), t.encode(), t))
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(found)[:ranks])]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_query_equals_direct_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = direct([(r.text, r.lang, r.source) for r in docs.collect()])
    assert result(LLM_QUERIES["op13_source_divergence"](spark, sf_dir)) == expected
    assert "op13_source_divergence" in LLM_ORACLES


def corpus(seed, rows):
    rng = random.Random(seed)
    words = ["the", "The", "a", "zebra", "été", "日本", "naïve", "x" * 300, "don", "ünder", "ab", "abc", "abd", "b"] + [f"w{chr(97 + i)}" for i in range(26)]
    for i in range(rows):
        text = rng.choice([None, "", "!!! 123", *[" ".join(rng.choices(words[: 8 + i % 30], k=rng.randrange(60))) + rng.choice([".", "\n", "\t9"]) for _ in range(9)]])
        yield text, rng.choice([None, "", "en", "en", "en", "de"]), rng.choice([None, "big", "big", "big", "s1", "s2", "S2", "été"])


@pytest.mark.parametrize("small", [False, True])
def test_rows_of_all_kinds(spark, monkeypatch, small):
    if small:  # many pieces, passes and blocks
        for name, value in (("PIECE_TERMS", 5), ("PASS_BYTES", 700), ("CELLS", 40), ("HELD_TERMS", 20)):
            monkeypatch.setattr(divergence, name, value)
    rows = [*corpus(4, 400), ("long " * 50_000 + "y" * 200_000, "en", "s1"), ("lonely", "xx", "only"), ("lonely words", "yy", "one"), (None, "yy", "two")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string")
    docs = docs.withColumn("S", F.lit(3)).withColumn("ordinal", F.lit(5))
    assert result(source_divergence(spark, docs)) == direct(rows)
    few = source_divergence(spark, docs, least=40, ranks=2)
    assert result(few) == direct(rows, 40, 2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence(spark, docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_transducer_numbers_terms_in_order(seed):
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choices("abcé日", k=rng.randrange(0 if seed else 1, 7))).encode() for _ in range(800)})
    built = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    asked = terms + [t + b"a" for t in terms] + [t[:-1] for t in terms]
    data = np.frombuffer(b"".join(asked) or b"\0", np.uint8)
    ends = np.cumsum([len(t) for t in asked])
    place = {t: i for i, t in enumerate(terms)}
    assert built.numbers(data, ends - [len(t) for t in asked], ends).tolist() == [place.get(t, -1) for t in asked]
    # minimal: as many states as different sets of endings
    endings = {p: frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in {t[:i] for t in terms for i in range(len(t) + 1)}}
    assert len(built.finals) == len(set(endings.values()))


def test_transducer_refuses_disorder():
    for terms in ([b"b", b"a"], [b"a", b"a"], [b"", b""]):
        with pytest.raises(ValueError):
            Transducer.build(terms)
    assert Transducer.build([]).numbers(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 1])).tolist() == [-1, -1]


def test_integer_shares():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.choice([rng.randrange(1, 50), rng.randrange(1, 10**15)])
        count = rng.randrange(0, total + 1)
        p = 1 + 10**9 * count // total
        assert shares(np.array([count]), np.array([total])).tolist() == [p]
        q = rng.randrange(1, 10**9 + 2)
        assert gaps(np.array([p]), np.array([q])).tolist() == [(p - q) ** 2 // (p + q)]
