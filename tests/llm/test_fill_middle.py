"""Cuts and forms against a direct version, exact round trips, edge rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm.fill_middle import Markers, UnitCutter, restored_text, with_fill_in_middle
from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def direct(doc_id, text):
    """Form, n, lengths and output of one text, token by token."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, "plain", n, None, None
    if h[3] % 100 < 80:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


def test_query_equals_direct_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = {}
    for r in docs:
        output, form, n, p, m = direct(r.doc_id, r.text)
        expected[r.doc_id] = (n, form, p, m, sha(output), sha(r.text or ""))
    rows = LLM_QUERIES["op11_fill_in_middle"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in rows} == expected
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and "op11_fill_in_middle" in LLM_ORACLES


def test_edge_rows(spark):
    texts = [None, "", " ", "\n\n\t", "one", " one", "one ", "a<P>b", "<S", "<<P>", "<", "S>x<", "é 日本 👩‍👩‍👧 　 x", "\x00 \x1c a", "w " * 100_000, "x" * 300_000, " " * 50_000]
    rows = [(i, t, i % 3) for i in range(40) for t in texts] + [(None, "no id here", 1), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FORM int").withColumn("body", F.col("FORM"))
    out = with_fill_in_middle(docs)
    assert out.columns == ["doc_id", "body", "output", "form", "n", "prefix_chars", "middle_chars"]
    rebuilt = out.withColumn("restored", restored_text(F.col("output"), F.col("form"))).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    expected = sorted(((i, *direct(i, t), t or "") for i, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.output, r.form, r.n, r.prefix_chars, r.middle_chars, r.restored) for r in rebuilt), key=key) == expected
    assert with_fill_in_middle(docs.filter("false")).count() == 0


def test_other_markers_and_shares(spark):
    docs = spark.createDataFrame([(i, f"some <P> words. number {i} [a|b]") for i in range(60)], "doc_id long, text string")
    markers = Markers("<|pre|>", "<|suf|>", "<|mid|>")
    out = with_fill_in_middle(docs, share=100, spm_share=0, markers=markers)
    rows = out.withColumn("restored", restored_text(F.col("output"), F.col("form"), markers)).collect()
    assert {r.form for r in rows} == {"psm"} and all(r.restored == f"some <P> words. number {r.doc_id} [a|b]" for r in rows)
    with pytest.raises(ValueError):
        Markers("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        Markers("ab", "bc", "x")
    with pytest.raises(ValueError):
        Markers("aa", "b", "c")


def test_every_repetition_is_kept():
    ends = UnitCutter().pattern.fullmatch("  foo bar\n\nbaz  ").ends(1)
    assert ends == [5, 9, 14, 16]
