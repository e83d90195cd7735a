"""Encoding and decoding against the sentencepiece library, and the compatibility test against merging itself."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskweave.llm.piece_bpe import PieceBpe, decoded_piece_ids, with_piece_ids
from riskweave.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return PieceBpe(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: library.encode(t) for i, t in texts.items()}
    expected = {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()}
    rows = LLM_QUERIES["op12_piece_bpe"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected


def test_hard_texts(library, coder):
    rng = random.Random(5)
    texts = [
        "", " ", "  ", "\n", " a", "a ", "a" * 5000, " " * 3000, "▁", "a▁b ▁", "ab" * 900, "<s>hi</s><unk>", "<0x41>", "\x00a\x00",
        "İstanbul ΣΑΣ ΟΔΥΣΣΕΥΣ ǅ ﬁ Å é é", "　x　", "👩‍👩‍👧 😀🏽", "한국어 각", "日本語の文字列です" * 60, "\t\r\n\x0b\x0c", "﻿hello", "�",
        "def f(x):\n        return {\n            'a': [1, 2,   3],\n        }\n" * 20, "antidisestablishmentarianism " * 40, "aaa aaaa aaaaa aaaaaa" * 50,
    ]
    words = [t for t in coder.tokens if len(t) > 2]
    texts += ["".join(rng.choice(words) for _ in range(40)).replace("▁", " ") for _ in range(500)]
    texts += ["".join(rng.choice("abcdeinorst ") for _ in range(200)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    for text, found in zip(texts, coder.encode(texts)):
        expected = library.encode(text)
        assert found.tolist() == expected, repr(text)
        assert coder.decode(found) == library.decode(expected), repr(text)


def test_every_code_point(library, coder):
    texts = [f"{chr(c)}a{chr(c)} b{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 200_000):
        piece = texts[at : at + 200_000]
        for text, ours, theirs in zip(piece, coder.encode(piece), library.encode(piece, num_threads=8)):
            assert ours.tolist() == theirs, repr(text)


def test_random_ids(library, coder):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(259, 32_000), 28705]) for _ in range(rng.randrange(12))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_compatible_means_that_merging_leaves_both(coder):
    def merged(text):
        parts = list(text)
        while True:
            places = [coder.place.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            if not places or min(places) == 1 << 40:
                return parts
            at = places.index(min(places))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    rng = random.Random(3)
    tokens = range(len(coder.tokens))
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    seen = set()
    for a, b in pairs:
        expected = merged(coder.tokens[a] + coder.tokens[b]) == [coder.tokens[a], coder.tokens[b]]
        assert coder.compatible(a, b) == expected, (coder.tokens[a], coder.tokens[b])
        seen.add(expected)
    assert seen == {True, False}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Two words", "z"), (3, "long " * 60_000, None), (4, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").withColumn("IDS", F.lit(1))
    out = with_piece_ids(docs, PATH).orderBy("doc_id", "body").collect()
    assert [(r.doc_id, len(r.ids)) for r in out[:4]] == [(None, 2), (1, 0), (2, 0), (2, 0)]
    assert [r.decoded for r in out] == ["Two words", "", "", "", "long " * 60_000, "x" * 200_000] and out[0].body == "z"
    again = decoded_piece_ids(with_piece_ids(docs, PATH).drop("decoded"), PATH).orderBy("doc_id", "body").collect()
    assert [r.decoded for r in again] == [r.decoded for r in out]
    assert with_piece_ids(docs.filter("false"), PATH).count() == 0


def test_another_kind_of_file_is_refused():
    with pytest.raises((ValueError, IndexError)):
        PieceBpe(public_tokenizers.path("byte_bpe_50k.json"))
