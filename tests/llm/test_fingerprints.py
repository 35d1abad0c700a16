"""Sketches against plain sets, and the query against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terragrid.llm import fingerprints as fp
from terragrid.llm.queries import op2_fingerprints

SCHEMA = "doc_id long, text string, key string, halo string, part string"


def brute(docs):
    """{id: (n_chars, edited sha, likeness to edited, to next)} with digests as plain sets."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        out.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, u), 9)))
    return sorted(out)


def like(a, b):
    x, y = ({int(k) for k in fp.digests(pa.array([t]))[1]} for t in (a, b))
    return 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op2_fingerprints(spark, sf)
    assert rows(out) == brute(docs)
    by_text = {}
    texts = dict(docs)
    for r in out.collect():
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    long = [r for r in out.collect() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.65 > 0.2 > np.median([r.near_next for r in long])


def test_nulls_ties_and_tiny_tables(spark):
    docs = [(5, "a b c\nd"), (None, "first of all " * 9), (5, "a b c\nd"), (5, None), (7, ""), (9, "\U0001f600é" * 30), (-3, "x y z " * 40), (11, "long " * 200_000)]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in docs], SCHEMA)
    assert rows(fp.versions(df)) == brute(docs)
    assert fp.versions(df.limit(0)).count() == 0
    one = df.where("doc_id = 9")
    assert rows(fp.versions(one)) == brute([docs[5]])


def test_peeling_recovers_all_differences():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    for only_a, only_b, both in [(0, 0, 10), (1, 0, 0), (0, 7, 500), (900, 1200, 3000), (5000, 1, 0), (0, 0, 0)]:
        a, b, c = np.split(keys[: only_a + only_b + both], [only_a, only_a + only_b])
        x, y = np.concatenate([a, c]), np.concatenate([b, c])
        pair, key, sign = fp.reconcile(np.zeros(len(x), np.int64), x, np.zeros(len(y), np.int64), y, 1)
        assert set(key[sign == 1]) == set(a) and set(key[sign == -1]) == set(b) and len(key) == only_a + only_b


def test_equal_pieces_are_counted():
    a, b = "one line\n" * 5, "one line\n" * 3
    (_, x), (_, y) = fp.digests(pa.array([a])), fp.digests(pa.array([b]))
    assert len(set(x) - set(y)) == 2 * (len(x) // 5) and not set(y) - set(x)


def test_differences(spark):
    rng = random.Random(2)
    w = [f"w{i}" for i in range(500)]
    texts = [(i, "".join(rng.choice(w) + rng.choice("   \n") for _ in range(rng.randrange(0, 300)))) for i in range(40)]
    pairs = [(i, t, t[: len(t) // 2] + t[len(t) // 3 :] if i % 2 else t) for i, t in texts] + [(99, None, "a"), (None, None, None)]
    recovered = 0
    for r in fp.differences(spark.createDataFrame(pairs, "doc_id long, old string, new string"), "old", "new").collect():
        old, new = next((o, n) for i, o, n in pairs if i == r.doc_id)
        x, y = (Counter(fp.paragraph_digests(pa.array([t], pa.string()))[1].view(np.int64).tolist()) for t in (old, new))
        assert r.removed == sorted((x - y).elements()) and r.added == sorted((y - x).elements())
        assert abs(r.likeness - like(old or "", new or "")) < 1e-9
        recovered += len(r.added)
    assert recovered > 100


def test_paragraphs_are_lines_with_words():
    text, key = fp.paragraph_digests(pa.array(["a b\n\n c d \na  b", None, "a b"]))
    assert text.tolist() == [0, 0, 0, 2] and len(set(key.tolist())) == 3 and key[0] == key[3]


@pytest.mark.parametrize("bits", [0, 1, 4, 8])
def test_peeling_ends_when_checks_collide(monkeypatch, bits):
    """A check of a few bits lets mixtures of keys pass: the peeling must end, with the right differences or an error."""
    whole = fp._check
    monkeypatch.setattr(fp, "_check", lambda k: whole(k) & np.uint64((1 << bits) - 1))
    rng = np.random.default_rng(bits)
    right = 0
    for _ in range(30):
        n = 200
        sizes = rng.integers(0, 60, 2 * n)
        text = np.repeat(np.arange(2 * n) % n, sizes)
        key = rng.integers(0, 2**63, len(text)).astype(np.uint64)
        a = np.arange(len(text)) < sizes[:n].sum()
        try:
            pair, got, sign = fp.reconcile(text[a], key[a], text[~a], key[~a], n)
        except ValueError:
            continue
        right += 1
        if bits == 8:
            assert len(got) == len(key) and set(zip(pair.tolist(), got.tolist(), sign.tolist())) == set(zip(text.tolist(), key.tolist(), np.where(a, 1, -1).tolist()))
    assert right or bits < 8


def test_many_pairs_are_all_recovered():
    rng = np.random.default_rng(3)
    for _ in range(5):
        n = 20_000
        sizes = rng.integers(0, 12, (2, n))
        (ta, tb), key = (np.repeat(np.arange(n), s) for s in sizes), rng.integers(0, 2**63, int(sizes.sum())).astype(np.uint64)
        ka, kb = key[: len(ta)], key[len(ta) :]
        shared = rng.random(len(tb)) < 0.3  # taken over from the other side
        both = np.flatnonzero(shared)
        ta, ka = np.concatenate([ta, tb[both]]), np.concatenate([ka, kb[both]])
        pair, got, sign = fp.reconcile(ta, ka, tb, kb, n)
        want = {(int(p), int(k), 1) for p, k in zip(ta[: len(ta) - len(both)], ka)} | {(int(p), int(k), -1) for p, k in zip(tb[~shared], kb[~shared])}
        assert len(got) == len(want) and set(zip(pair.tolist(), got.tolist(), sign.tolist())) == want


def test_tied_ids_are_split_by_text(spark):
    docs = [(None, f"text {i % 37} of no id " * (1 + i % 5)) for i in range(300)] + [(4, "one"), (4, "two"), (-9, "last of all")]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in docs], SCHEMA).repartition(5)
    assert rows(fp.versions(df)) == brute(docs)
    ranges = fp._with_next(df, "doc_id", "text").where("id IS NULL AND NOT halo").select("part").distinct().count()
    assert ranges > 3
