"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.bpe import WordBpe, decoded_ids, with_token_ids
from riskweave.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    expected = {
        i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()
    }
    rows = LLM_QUERIES["op10_bpe"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == expected


def test_hard_texts(library):
    rng = random.Random(5)
    texts = [
        "", " ", "a" * 5000, "ababababa" * 300, "aaa aaaa aaaaa", "<|startoftext|>x<|endoftext|><|endoftext|>", "<|startof text|>",
        "İstanbul ΣΑΣ ΟΔΥΣΣΕΥΣ ǅ ﬁ Å é", "it's 'TWAS we'LL I'd x'vez '' '", "12 3٣४½ Ⅷ", "\x1c\x1d\x85​ 　x\x00y", "👩‍👩‍👧 😀🏽",
        "한국어 각", "\t\r\n\x0b\x0c", "ａｂｃ ＡＢＣ", "ẹ́", "́ͅ", "﻿hello",
    ]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    coder = WordBpe(PATH)
    for text, found in zip(texts, coder.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert found.tolist() == expected, repr(text)
        assert coder.decode(found) == library.decode(expected, skip_special_tokens=False)


def test_every_code_point(library):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}a{chr(c)}b {chr(c)}1{chr(c)}!" for c in codes]
    coder = WordBpe(PATH)
    for at in range(0, len(texts), 100_000):
        piece = texts[at : at + 100_000]
        found = coder.encode(piece)
        for text, ours, theirs in zip(piece, found, library.encode_batch(piece, add_special_tokens=False)):
            assert ours.tolist() == theirs.ids, repr(text)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "Two words", "z"), (3, "long " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string").withColumn("IDS", F.lit(1))
    out = with_token_ids(docs, PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.ids)) for r in out] == [(None, 2), (1, 0), (2, 0), (2, 0), (3, 60_000)]
    assert out[0].decoded == "two</w> words</w>" and out[0].body == "z" and out[1].decoded == ""
    again = decoded_ids(with_token_ids(docs, PATH).drop("decoded"), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in again] == [r.decoded for r in out]
    assert with_token_ids(docs.filter("false"), PATH).count() == 0


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
