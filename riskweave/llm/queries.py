"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import secrets
from riskweave.llm.bpe import token_digests, with_token_ids
from riskweave.llm.decontaminate import benchmark_hits
from riskweave.llm.divergence import source_divergence
from riskweave.llm.fill_middle import fill_in_middle_digests, with_fill_in_middle
from riskweave.llm.language_id import fit_languages, with_languages
from riskweave.llm.line_dedup import line_report
from riskweave.llm.lm_scoring import text_scores
from riskweave.llm.nearest import nearest
from riskweave.llm.piece_bpe import piece_digests, with_piece_ids
from riskweave.llm.scratch import saved
from riskweave.llm.simhash import simhash_components
from riskweave.llm.token_counts import TokenRollup, signed, word_count
from riskweave.llm.toxicity import fit_toxicity, with_toxicity
from riskweave.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(parts: int) -> Column:
    """The crc32 of the id, written as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def _held_out(parts: int, remainder: int) -> Column:
    return F.coalesce(_remainder(parts) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = fit_languages(spark, docs.select("doc_id", "text", "lang"), _remainder(4) != 2)
    return with_languages(spark, docs.select("doc_id", _held_out(4, 2), "text"), found, keep_text=False)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(spark, rows, F.col("vec_id") % 20 == 0, count=20)


OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    training = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2
    found = secrets.scan(spark, docs, training=training)
    return found.select(
        F.col("id").alias("doc_id"), "place", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        F.col("label").alias("format_label"), "score", "is_secret",
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(spark, docs, _table(spark, sf_dir, "benchmark"), width=10, keep_text=False)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))
), hits AS (
  SELECT doc_id, grams.k, i, item_id FROM grams JOIN windows ON grams.k = windows.k AND grams.gram = windows.gram
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(item_list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_report(spark, docs, percent=80)
    return found.select(
        "doc_id", "n_lines", "n_links", F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
    )


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(
    translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM lines
), named AS (
  SELECT doc_id, line, s, dense_rank() OVER (ORDER BY s) AS c FROM sets WHERE len(s) > 0
), classes AS (
  SELECT c, any_value(s) AS s, len(any_value(s)) AS n, min((doc_id, line)) AS place FROM named GROUP BY c
), tokens AS (
  SELECT c, n, unnest(s) AS t FROM classes
), ordered AS (
  SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY f, t) AS p FROM tokens JOIN (SELECT t, count(*) AS f FROM tokens GROUP BY t) USING (t)
), prefixes AS (
  SELECT c, n, t FROM ordered WHERE p <= n - (80 * n + 99) // 100 + 1
), pairs AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.c <> b.c AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
), links AS (
  SELECT a, b, y.place FROM pairs JOIN classes x ON a = x.c JOIN classes y ON b = y.c
  WHERE len(list_intersect(x.s, y.s)) * 180 >= 80 * (x.n + y.n)
), bounds AS (
  SELECT c, least(any_value(classes.place), coalesce(min(links.place), any_value(classes.place))) AS first, count(links.b) AS n_links
  FROM classes LEFT JOIN links ON a = c GROUP BY c
), marked AS (
  SELECT doc_id, line, n_links, (doc_id, line) > first AS later FROM named JOIN bounds USING (c)
), found AS (
  SELECT doc_id, count(*) AS n_lines, sum(n_links) AS n_links, count(*) FILTER (later) AS n_removed,
    string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (later) AS removed_lines FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed_lines, '') AS removed_lines FROM documents LEFT JOIN found USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    found = fit_toxicity(spark, docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), _remainder(5) != 0)
    return with_toxicity(spark, docs.select("doc_id", _held_out(5, 0), "text"), found, keep_text=False)


#: Tokens of the two versions that op7 counts with: runs without white space, and runs of letters, digits and non-ASCII.
TOKENIZERS = {"blanks-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents counted by the first version; the toxic ones withdrawn; those of low
    quality recounted by the second; and the withdrawal committed again."""
    first, second = TOKENIZERS
    counted = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", *[word_count(F.col("text"), p).alias(v) for v, p in TOKENIZERS.items()])
    counted = saved(spark, counted, "counted")
    marks = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic = counted.join(marks.filter("toxic = 1"), "doc_id", "left_semi")
    revised = counted.join(marks.filter("toxic = 0 and quality = 0"), "doc_id", "left_semi")
    rollup = TokenRollup(spark, scratch_path(spark, "token-counts"))
    rollup.commit("inserts", signed(counted, 1, first, first))
    rollup.commit("withdrawals", signed(toxic, -1, first, first))
    rollup.commit("revisions", signed(revised, -1, first, first), signed(revised, 1, second, second))
    rollup.commit("withdrawals", signed(toxic, -1, first, first))
    return rollup.totals()


OP7_SQL = r"""
WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
state AS (
  SELECT source, lang, CASE WHEN toxic = 0 AND quality = 0 THEN 'words-2' ELSE 'blanks-1' END AS tokenizer, coalesce(text, '') AS text
  FROM documents LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs,
  sum(len(regexp_extract_all(text, CASE tokenizer WHEN 'words-2' THEN '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' ELSE '[^\x20\x09-\x0D]+' END)))::BIGINT AS tokens
FROM state GROUP BY ALL
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_scores(spark, docs.select("doc_id", _held_out(7, 2), "text"), _remainder(7) != 2)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(spark, docs, width=4, distance=4).drop("component_label")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(with_token_ids(docs, public_tokenizers.path("word_bpe_49k.json")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle_digests(with_fill_in_middle(docs, seed=42, share=50, spm_share=80))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    ('0x' || h[17:24])::BIGINT % 100 AS c3, ('0x' || h[25:32])::BIGINT % 100 AS c4 FROM d
), cut AS (
  SELECT doc_id, t, n, array_to_string(u[1 : least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1 : n], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 50 THEN 'plain' WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM cut
"""


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(with_piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", "lang", "source")
    return source_divergence(spark, docs, least=10, ranks=10)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), shares AS (
  SELECT k.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * v) AS p
  FROM kept k JOIN sizes USING (lang) JOIN totals t USING (lang) LEFT JOIN counted c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // (any_value(total) + 2 * any_value(v)) AS q
  FROM shares JOIN sizes USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER w)::INTEGER AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) QUALIFY part = 'pair' OR row_number() OVER w <= 10
"""


LLM_QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_bpe": op10_bpe,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_source_divergence": op13_source_divergence,
}

LLM_ORACLES: dict[str, str] = {
    "op2_nearest_neighbours": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_token_counts": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
