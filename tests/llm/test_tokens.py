"""Encoding and token counts against the tokenizer libraries themselves."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terragrid.llm import bpe, token_counts
from terragrid.llm.queries import op4_bpe_roundtrip, op9_token_counts
from terragrid.llm.text import units

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a", " a  b\n\n c \t d ", " x   y  z　", "a\x1cb \x1c c", "x" * 5000, "ab" * 3000, "\U0001f600 \U0001f600é̂", "it's we'll I'd  'S", "1234567 89", "<|endoftext|> a<|endoftext|>", "\r\n\r\n x", "�￾"]
SCHEMA = "doc_id long, text string, lang string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder(ranks, public_tokenizers.PATTERN)


def random_texts(n):
    rng = random.Random(7)
    sets = ["abcdef ghij", "the and ing\n\t ", "éè 你好да", " \n\r\t  \x0b\x85", "aA1'! .,", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300))]
    return ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def test_encoder_equals_library(library):
    enc, own = library
    for text in [*ODD, *random_texts(3000)]:
        assert own.text(text) == enc.encode_ordinary(text), repr(text)


def test_units_join_to_the_texts_and_encode_alike(library):
    enc, own = library
    texts = [*ODD, None, *random_texts(1500)]
    off, flat = units(pa.array(texts))
    for i, t in enumerate(texts):
        parts = flat[int(off[i]) : int(off[i + 1])].to_pylist()
        assert "".join(parts) == (t or "")
        assert [x for p in parts for x in own.text(p)] == enc.encode_ordinary(t or "")


def test_op4_whole_table(spark, sf, library):
    enc, _ = library
    for r, d in rows(op4_bpe_roundtrip(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")):
        ids = enc.encode_ordinary(d.text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def rows(out, docs):
    want = {d.doc_id: d for d in docs.collect()}
    got = out.collect()
    assert len(got) == len(want)
    return [(r, want[r.doc_id]) for r in got]


def test_op9_whole_table(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r, d in rows(op9_token_counts(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")):
        n = len(t.encode(d.text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), n, n > 512)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_odd_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [*ODD, None, *random_texts(300)]
    df = spark.createDataFrame([(i if i % 7 else None, t, None, "x") for i, t in enumerate(texts)], SCHEMA)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(p.encode(x or "")) for x in texts]
    got = token_counts.token_counts(df.coalesce(1), path).collect()
    assert [r.n_tokens for r in got] == want


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    one = bpe.encode(spark.createDataFrame([(None, None, "x", "y")] * 2, SCHEMA), RANKS, public_tokenizers.PATTERN)
    assert [(r.n_tokens, bytes(r.ids)) for r in one.collect()] == [(0, b"")] * 2
    assert [bytes(r.decoded) for r in bpe.decode(one, RANKS).collect()] == [b""] * 2
    both = bpe.encode(spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y")], SCHEMA), RANKS, public_tokenizers.PATTERN, decoded=True)
    assert [(r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in both.collect()] == [(0, b"", b"")] * 2


def test_pairs_are_judged_as_the_merges_do(library):
    _, own = library
    rng = random.Random(4)
    known = list(own.halves)
    apart = 0
    for _ in range(20_000):
        a, b = rng.choice(known), rng.choice(known if rng.random() < 0.5 else known[:2000])
        want = own.merge(own.tokens[a] + own.tokens[b]) == [a, b]
        assert own._may_follow(a, b) == want
        apart += not want
    assert apart > 100


def test_long_pieces_are_encoded_by_windows(library, monkeypatch):
    enc, own = library
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgéñ") for _ in range(5000)), "er" * 3000 + "ing" * 2000, " " * 9000 + "x" * 5000]
    monkeypatch.setattr(bpe, "WINDOW", 37)
    for t in texts:
        assert own.text(t) == enc.encode_ordinary(t)
    monkeypatch.setattr(bpe, "WINDOW", 1 << 13)
    own.release()
    assert own.text(texts[0] * 60) == enc.encode_ordinary(texts[0] * 60)
    assert own.held <= bpe.KEPT_BYTES


def test_very_long_texts(spark, library):
    enc, _ = library
    rng = random.Random(9)
    texts = ["w" + "".join(rng.choice("etaoin") for _ in range(400_000)), "the words of a long text " * 400_000]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN).withColumn("held", F.col("ids")), RANKS, "held").collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == np.array(enc.encode_ordinary(t), "<u4").tobytes() and got[i].decoded == t.encode()
    both = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in both.collect()} == {i: (r.n_tokens, r.ids, r.decoded) for i, r in got.items()}
    counts = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert [r.n_bytes for r in sorted(counts)] == [len(t) for t in texts]


def test_kept_counts_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 50_000)
    known = token_counts._Known()
    pieces = [f"{i:0{i % 9000 + 1}d}" for i in range(300)]
    for _ in range(2):
        assert known.of(pieces, lambda b: [len(x) for x in b]).tolist() == list(map(len, pieces))
    assert 0 < known.held <= 50_000 and 0 < len(known.counts) < len(pieces)


def test_many_distinct_pieces_are_encoded_once_a_task(monkeypatch):
    """A task's text has some hundred thousand distinct words; a few ten thousand kept ones left the others to be encoded in each slice."""
    enc = bpe.Encoder({bytes([i]): i for i in range(256)}, public_tokenizers.PATTERN)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(150_000)]
    first = [enc.unit(w) for w in words]
    monkeypatch.setattr(enc, "piece", lambda piece: pytest.fail("encoded again"))
    assert [enc.unit(w) for w in words] == first
    assert enc.held <= bpe.KEPT_BYTES
