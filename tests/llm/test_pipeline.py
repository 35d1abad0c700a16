"""The pipeline against its stages' brute-force versions, one after the other."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from terragrid.llm import bpe
from terragrid.llm.queries import ORACLES
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_substring_dedup import brute


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def steps(spark: SparkSession, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    out = [docs.toPandas()]
    schema = docs.schema
    for _, f in corpus_pipeline.STAGES[:-1]:
        pdf = f(spark, spark.createDataFrame(out[-1], schema), sf).toPandas()
        assert list(pdf.columns) == schema.names
        out.append(pdf)
    return out


def test_languages_keep_clean_documents(steps):
    before, after = steps[0], steps[1]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert len(gone) <= 0.02 * len(before)
    assert all(len(t.split()) < 10 or not any(c.isalpha() for c in t) for t in gone.text)


def test_languages_keep_clean_short_documents(steps):
    before, after = steps[0], steps[1]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert not any(len(t.split()) < 10 and t.replace(" ", "").strip(".,;:!?").isalpha() for t in gone.text)


def test_one_of_each_class_stays(steps):
    before, after = steps[1], steps[2]
    classes = brute_classes(list(zip(before.doc_id.tolist(), before.text)))
    assert sorted(after.doc_id) == sorted(set(classes.values()))


def test_spans_are_removed(steps):
    before, after = steps[2], steps[3]
    kept = {i: k for i, _, removed, k in brute(list(zip(before.doc_id.tolist(), before.text))) if removed}
    texts = dict(zip(before.doc_id, before.text))
    assert len(before) == len(after) and kept
    for r in after.itertuples():
        assert r.text == kept.get(r.doc_id, texts[r.doc_id]) and r.n_chars == len(r.text)


def test_mix_is_the_sql(steps):
    before, after = steps[3], steps[4]
    con = duckdb.connect()
    con.register("documents", before)
    want = con.execute(ORACLES["op6_fair_mix"]).fetchdf()
    copies = Counter(after.doc_id.tolist())
    for r in want.itertuples():
        assert copies[r.doc_id] == (r.taken // r.size if r.size else 0)


def test_run(spark, sf, steps):
    import tiktoken

    with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = Counter()
    for r in steps[4].itertuples():
        ids = enc.encode_ordinary(r.text)
        want[r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
    rows = [(i, f"the word {i} and other words of the text {i * 7} are here to stay", "en", "s", 10, None, "x") for i in range(20)]
    rows += [(None, None, None, None, None, None, None), (3, "", "en", None, 0, "a", "b"), rows[0]]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, sf)
            assert name == "encode" or out.columns == docs.columns
            n = out.count()
            docs = spark.createDataFrame(out.collect(), out.schema) if name != "encode" else out
        assert (n > 0) == bool(data)
