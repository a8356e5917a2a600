"""Encoding, decoding and counting against the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import sentencepiece_bpe, token_counts
from tidewatch.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"

HARD = [
    "", " ", "  a  b ", "\ta\n\nb", "<s>x</s>", " a　b", "ﬁ ▁x", "\x00a", "é é", "▁▁ a▁b", "﻿a", "<0x0A>",
    " <unk>", "      x       y", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "don't I'LL we've 12³ ½ x_y", "中文字 Ж 🙂🙂",
    "a" * 5000, " " * 3001, "\n" * 777, "ab" * 2000 + "▁" * 50, "\x1c\x1d\x85  a", "x ​ y",
]


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(5)
    alphabet = "aeiou rstln\n\t. ,'<|>▁éßЖ中🙂 \x85́019ABC"
    several = ["".join(draw.choices(alphabet, k=draw.randint(0, 90))) for _ in range(1500)]
    anything = ["".join(chr(c) for c in draw.choices(range(1, 0x2FFFF), k=30) if not 0xD800 <= c < 0xE000) for _ in range(400)]
    every = ["a" + chr(c) + " b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    return HARD + several + anything + every


def test_encoding_and_decoding_equal_the_library(mixed):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    mine = sentencepiece_bpe.Encoder(MODEL)
    for text in mixed:
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed = mine.encode(text)
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)
        assert mine.decode(packed) == library.decode(ids)


def test_walk_equals_merging():
    mine, draw = sentencepiece_bpe.Encoder(MODEL), random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices("▁theranoiy", k=draw.randint(1, 24)))
        assert mine.pieces(text) == mine.merge(text)


def test_counts_equal_the_library(mixed):
    library = Tokenizer.from_file(VOCABULARY)
    mine = token_counts.Counter(VOCABULARY)
    for text in mixed:
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_small_caches_change_nothing(mixed):
    mine, small = sentencepiece_bpe.Encoder(MODEL), sentencepiece_bpe.Encoder(MODEL)
    small.segments.limit = small.compatible.limit = 3
    assert [mine.encode(t) for t in mixed[:300]] == [small.encode(t) for t in mixed[:300]]
    assert len(small.segments) <= 3


def test_edges(spark):
    schema = "ids string, doc_id long, text string, n_tokens string"
    rows = [("x", 1, None, "a"), ("x", 1, None, "a"), (None, None, "", None), ("y", 2, "Hi " * 40000, "b")]
    df = spark.createDataFrame(rows, schema)
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df, MODEL), MODEL).collect()
    assert sorted((r.n_tokens, len(r.decoded)) for r in got)[:3] == [(2, 0)] * 3
    assert max(len(r.decoded) for r in got) == 120000
    assert sorted(r.n_tokens for r in token_counts.count_tokens(df, VOCABULARY).collect())[:3] == [0, 0, 0]
    assert sentencepiece_bpe.encode(df.limit(0), MODEL).count() == 0
    assert token_counts.count_tokens(df.limit(0), VOCABULARY).columns == ["ids", "doc_id", "text", "n_tokens"]


def test_queries_against_the_libraries(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    library, other = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(VOCABULARY)
    got = QUERIES["op1_sentencepiece"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for r in QUERIES["op9_token_counts"](spark, SF_DIR).collect():
        n = len(other.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


