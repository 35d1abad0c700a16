"""Repeated windows against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terragrid.llm import substring_dedup
from terragrid.llm.queries import op3_repeated_spans

SCHEMA = "doc_id long, text string, id string, block string, kept string"


def brute(docs, n=13):
    """(id, words, removed, kept) of (id, text) rows; a null id is larger than all others."""
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - n + 1):
            f = first.get(tuple(w[p : p + n]))
            if f is not None and (i is None or f < i):
                gone.update(range(p, p + n))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, a, b, hashlib.sha256(k.encode()).hexdigest()) for i, a, b, k in brute(docs)]
    assert sum(x[2] for x in want) > 1000
    assert sorted(map(tuple, op3_repeated_spans(spark, sf).collect())) == want


@pytest.mark.parametrize(("n", "seed"), [(13, 1), (13, 2), (4, 3), (7, 4)])
def test_random_overlaps(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    parts = [[rng.choice(words) for _ in range(rng.randrange(3, 40))] for _ in range(25)]
    docs = []
    for i in rng.sample(range(1000), 150):
        w = [x for _ in range(rng.randrange(0, 6)) for x in rng.choice(parts)[rng.randrange(0, 4) :]]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    docs += rng.sample(docs, 10) + [(None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, " \x0b "), (2003, "a\x1cb  c")]
    docs += [(docs[5][0], "another text with the same id " * 9)]
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in docs], SCHEMA)
    assert rows(substring_dedup.deduplicate(df, n)) == brute(docs, n)


def test_long_text_empty_table_and_columns(spark):
    long = " ".join(f"v{i % 70000}" for i in range(150_000))
    docs = [(1, long), (2, "x " + long[: len(long) // 2])]
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in docs], SCHEMA)
    assert rows(substring_dedup.deduplicate(df)) == brute(docs)
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0
    out = substring_dedup.deduplicated(df.selectExpr("*", "length(text) AS n_chars"))
    assert out.columns == [*df.columns, "n_chars"]
    assert {r.doc_id: r.text for r in out.collect()}[1] == long


def test_rows_of_one_id_are_split(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(30))
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) + " " + line) for i in [None] * 60 + [7] * 60 + [3, 9]]
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in docs], SCHEMA)
    assert rows(substring_dedup.deduplicate(df)) == brute(docs)
    blocks = substring_dedup._dealt_documents(df, "doc_id", "text", [])[0].where("id IS NULL").select("block").distinct().count()
    assert blocks > 6


def test_equal_hashes_of_words_do_not_pass(spark, monkeypatch):
    """Where all words hash alike, only spans with equal words are removed."""
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda flat: np.zeros(len(flat), np.uint64))
    t = pa.table({"text": ["a b c d e", "a b c d e", "v w x y z"], "id": [1, 2, 3]})
    block = substring_dedup._Block(t)
    x, y = substring_dedup._digests(block.words, np.array([0, 5, 10]), np.array([5, 5, 5]))
    assert x[0] == x[1] and y[0] == y[1] and x[0] != x[2]
    a, _ = substring_dedup._digests(pa.array(["ab", "c", "a", "bc"]), np.array([0, 2]), np.array([2, 2]))
    assert a[0] != a[1]


def test_equal_rows_are_split_over_blocks(spark):
    """Rows without an id, and of one text, are dealt by where they were read."""
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text)] * 4000 + [(None, None)] * 4000 + [(7, text)], "doc_id long, text string").repartition(8)
    docs, _ = substring_dedup._dealt_documents(df, "doc_id", "text", [])
    assert docs.groupBy("block").count().agg({"count": "max"}).first()[0] < 3000
    out = substring_dedup.deduplicate(df)
    assert out.groupBy("n_words", "n_removed").count().orderBy("n_words", "n_removed").collect() == [(0, 0, 4000), (20, 0, 1), (20, 20, 4000)]  # a null id is no source
