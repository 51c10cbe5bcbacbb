"""Token counts and byte-level BPE against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from descry.llm import bpe, tokencount

MODEL, RANKS, PATTERN = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [
        None, "", " ", "  a   b\n\n\t x", "a" * 700, " " * 400, "http://foo.bar/" * 60, "日本語テキスト 🤔🤔 é ﬁ", "<s> </s> <unk> <0x0A> <|endoftext|>",
        "▁▁ x ▁", "\u0000abc", "same", "same", "word1 " * 30_000, "x1y2" * 20_000,
    ]
    out += ["".join(rng.choice("abcde \n\té日ab the in on 0123=-_/\\{}'sS") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as n_tokens")


def test_counts(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or ""))), t
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_ragged_rows_of_any_length(texts, monkeypatch):
    """Ragged rounds give the library's counts for short rows as well, and for single pre-tokens of 100,000 symbols and beyond a block."""
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), tokencount.Merges(MODEL)

    def counts(some):
        raw = [(t or "").encode() for t in some]
        return m.counts(np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)).tolist()

    rng = random.Random(8)
    long = ["a" * 1_300_000, "".join(rng.choice("abcdethineraouon") for _ in range(100_000)), "ab" * 50_000 + "thethe" * 3000]
    assert counts(long) == [len(sp.encode(t)) for t in long]
    monkeypatch.setattr(tokencount, "WIDE", 2)
    assert counts(texts) == [len(sp.encode(t or "")) for t in texts]


def test_clashing_codes_are_told_apart(monkeypatch):
    """With a hash that makes everything equal, the counts stay right."""
    m = tokencount.Merges(MODEL)
    monkeypatch.setattr(tokencount, "powers", lambda n: [np.zeros(n, np.uint64)] * 2)
    raw = "the cat sat on the mat with another cat".encode()
    import sentencepiece

    assert m.counts(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0] == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(raw.decode()))


def test_bpe(docs, texts):
    whole = bpe.Codec(RANKS, PATTERN).encoding
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = whole.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).select("doc_id", "decoded").collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in back)


def test_pieces_are_safe(texts):
    whole = bpe.Codec(RANKS, PATTERN).encoding
    for t in [x for x in texts if x]:
        parts = list(bpe.pieces(t, 7))
        assert "".join(parts) == t
        assert [i for p in parts for i in whole.encode_ordinary(p)] == whole.encode_ordinary(t)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count_tokens(none, MODEL).count() == bpe.round_trip(none, RANKS, PATTERN).count() == 0
