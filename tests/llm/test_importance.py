"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terragrid.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def bucket(x, buckets):
    return zlib.crc32(x.encode()) % buckets


def brute(docs, target, buckets=10_000, percent=5, min_words=20):
    """(id, n_features, weight, score, rank) of (id, text) rows."""
    s, t, each = Counter(), Counter(), []
    for _, text in docs:
        each.append(features(text))
        for x, n in each[-1][1].items():
            s[bucket(x, buckets)] += n
    for text in target:
        for x, n in features(text)[1].items():
            t[bucket(x, buckets)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n_words, f) in zip(docs, each):
        weight = sum(gain[bucket(x, buckets)] * n for x, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple((x is None, x) for x in r)


def test_query_is_the_definition(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(map(tuple, queries.op11_importance(spark, sf).collect()))
    want = sorted(brute(docs, target))
    assert got == want and sum(r[4] is not None for r in got) > 0


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_odd_rows(spark, monkeypatch, window):
    """Nulls, empty and long texts, repeated rows, ties, non-ASCII words, words of one text that border on another's, windows of few words."""
    monkeypatch.setattr(importance, "WINDOW", window)
    base = "Der ÄPFEL baum 7 steht_im wald  und\tder wald ist naß 東京 also go home now or stay where you are friend of mine"
    docs = [(1, None), (2, ""), (3, "a"), (4, " \n.-"), (5, base), (5, base), (6, base.upper()), (7, base + " x" * 3000), (None, base), (None, None), (8, "naß"), (9, "b c")]
    docs += [(i, f"{base} number {i % 3} of {i % 4}") for i in range(20, 60)]
    target = [None, "", "der wald ist naß und 東京", "go home"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("x"), "rank": F.lit(1)})
    out = importance.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), percent=30)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(docs, target, percent=30), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string")
    assert importance.resampled(none, some).collect() == []
    assert [tuple(r) for r in importance.resampled(some, none, percent=100).collect()] == brute([(1, "one two " * 20)], [], percent=100)


def test_dictionary_holds_each_feature_once(spark, monkeypatch):
    monkeypatch.setattr(importance, "WINDOW", 5)
    monkeypatch.setattr(importance, "PART_CHARS", 10)
    texts = ["a b a b a b", "B; a\nb", None, "ü 1"]
    rows = importance.feature_dictionary(spark.createDataFrame([(t,) for t in texts], "text string"), buckets=100).collect()
    want = sum((features(t)[1] for t in texts), Counter())
    assert len(rows) == len(want) and {r.feature: r.n for r in rows} == want
    assert all(r.bucket == bucket(r.feature, 100) for r in rows)


def test_draws_agree_with_shares(spark):
    """Texts of the target's words are drawn, texts of other words are not."""
    docs = spark.createDataFrame([(i, ("near the target words " if i % 10 == 0 else "far from all that ") * 10) for i in range(400)], "doc_id long, text string")
    drawn = importance.resampled(docs, spark.createDataFrame([("near the target words",)], "text string")).where("rank IS NOT NULL").collect()
    assert len(drawn) == 20 and all(r.doc_id % 10 == 0 for r in drawn)


def test_too_many_buckets(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        importance.weighed(df, spark.range(1).selectExpr("id bucket", "id gain"), buckets=importance.MAX_BUCKETS + 1)
