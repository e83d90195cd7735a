"""Totals against SQL; repeated, compacted and empty batches."""

from check_oracle import difference, oracle_connection

from riskweave.llm.queries import LLM_ORACLES, LLM_QUERIES
from riskweave.llm.token_counts import TokenRollup, signed, word_count
from riskweave.session import scratch_path


def test_query_equals_sql(spark, sf_dir):
    ours = LLM_QUERIES["op7_token_counts"](spark, sf_dir).toPandas()
    assert difference(ours, oracle_connection(sf_dir).execute(LLM_ORACLES["op7_token_counts"]).df()) is None
    assert set(ours["tokenizer"]) == {"blanks-1", "words-2"}


def test_batches(spark):
    rows = spark.createDataFrame([("a", "en", 5, 0), ("a", "en", 7, 0), (None, None, 1, 0), ("b", None, None, 0)], "source string, lang string, t int, docs int")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    rollup.compact("nothing", ["x"])

    def state():
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}

    for _ in range(2):
        assert rollup.commit("one", signed(rows, 1, "v1", "t"))
        assert state() == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 1), ("b", None, "v1"): (1, 0)}
    revised = rows.filter("t = 7")
    for _ in range(2):
        rollup.commit("two", signed(revised, -1, "v1", "t"), signed(revised, 1, "v2", "t"))
        rollup.commit("three", signed(rows.filter("source is null"), -1, "v1", "t"))
        rollup.commit("none", signed(rows.filter("false"), 1, "v1", "t"))
        expected = {("a", "en", "v1"): (1, 5), ("a", "en", "v2"): (1, 7), ("b", None, "v1"): (1, 0)}
        assert state() == expected
    rollup.compact("all", ["one", "two", "three"])
    assert state() == expected
    assert not rollup.commit("one", signed(rows, 1, "v1", "t")) and state() == expected
    rollup.commit("four", signed(revised, -1, "v2", "t"))
    assert state() == {("a", "en", "v1"): (1, 5), ("b", None, "v1"): (1, 0)}


def test_a_batch_that_became_empty_takes_its_totals_along(spark):
    rows = spark.createDataFrame([("a", "en", 5, "clash", 9)], "source string, lang string, t int, tokenizer string, tokens int")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("one", signed(rows, 1, "v1", "t"))
    rollup.commit("two", signed(rows, 1, "v1", "tokens"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 14)]
    rollup.commit("one", signed(rows.filter("false"), 1, "v1", "t"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 9)]


def test_compacting_again_keeps_all_totals(spark):
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, t int")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))

    def state():
        return [tuple(r) for r in rollup.totals().collect()]

    for batch in ("one", "two", "three"):
        rollup.commit(batch, signed(rows, 1, "v1", "t"))
    for _ in range(2):
        rollup.compact("all", ["one"])
        assert state() == [("a", "en", "v1", 3, 15)]
    rollup.compact("all", ["two", "never committed"])
    assert state() == [("a", "en", "v1", 3, 15)]
    assert not rollup.commit("all", signed(rows, 1, "v1", "t")) and not rollup.commit("two", signed(rows, -1, "v1", "t"))
    assert rollup.commit("never committed", signed(rows, 1, "v1", "t"))
    assert rollup.commit("three", signed(rows.filter("false"), 1, "v1", "t"))
    rollup.compact("older", ["all", "three"])
    rollup.compact("older", ["never committed"])
    assert state() == [("a", "en", "v1", 3, 15)]
    assert not any(rollup.commit(b, signed(rows, 1, "v1", "t")) for b in ("one", "two", "three", "all", "older", "never committed"))


def test_word_count(spark):
    text = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc ",), ("x" * 100_000 + " é",)], "text string")
    assert [r[0] for r in text.select(word_count(text.text, r"[^\x20\x09-\x0D]+")).collect()] == [0, 0, 3, 2]
