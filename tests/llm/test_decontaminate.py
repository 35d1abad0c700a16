"""Decontamination against a plain version of its definition, and spans in the original texts."""

import hashlib
import re

import pytest

from terragrid.llm import decontaminate, queries
from tests.oracle import differences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    found = []
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        found += [(item or "", w[i : i + m]) for i in range(len(w) - m + 1) if m]
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, win in found:
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    names.add(item)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [("q1", "What is the Capital of France, and why is it so?"), ("q2", "short one"), ("q3", None), ("q4", "..."), (None, "no id here"), ("q5", "Short-One"), ("q6", "Größe 東京"), ("q1", "another text of the first item")]
DOCS = [
    (1, None),
    (2, ""),
    (3, "He asked: WHAT is the capital of France and why is it so? Short; one!"),
    (3, "He asked: WHAT is the capital of France and why is it so? Short; one!"),
    (4, "what is the capital of france and why is it wrong"),
    (5, "ashort one short ones"),
    (6, "short one short one SHORT\tONE"),
    (7, "größe 東京 and GRößE 東京"),
    (8, "GRÖSSE 東京 another text of the first item"),
    (None, "no  id...here no id here"),
    (9, "word " * 30_000 + "short one" + " word" * 30_000),
]


def rows(out):
    return sorted(map(tuple, out.collect()), key=lambda r: tuple((x is None, x) for x in r))


def as_query(out):
    from pyspark.sql import functions as F

    return out.select("doc_id", "n_words", decontaminate.n_hit(F.col("spans")).alias("h"), F.size("items").alias("i"), F.sha2(F.array_join("items", ","), 256).alias("s"), (F.size("spans") > 0).alias("c"))


@pytest.mark.parametrize("max_chars", [1 << 20, 40])
def test_odd_rows(spark, max_chars):
    """One automaton, or several after one another, give what the definition gives."""
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    out = decontaminate.contamination(docs, items, max_chars=max_chars)
    assert rows(as_query(out)) == sorted(brute(DOCS, ITEMS), key=lambda r: tuple((x is None, x) for x in r))


def test_spans_in_the_original(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    at = {(r.doc_id, s["start"]): r.text[s["start"] : s["end"]] for r in decontaminate.contamination(docs, items).collect() for s in r.spans}
    assert at[3, 10] == "WHAT is the capital of France and why is it so? Short; one"
    assert at[6, 0] == "short one short one SHORT\tONE" and at[7, 0] == "größe 東京" and at[9, 150_000] == "short one"


def test_query_is_the_definition_and_the_sql(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(brute(docs, items))
    assert sorted(map(tuple, queries.op12_decontaminate(spark, sf).collect())) == want and any(r[5] for r in want)
    assert differences(spark, queries.op12_decontaminate, queries.ORACLES["op12_decontaminate"]) == ""


def test_decontaminated_keeps_clean_rows_and_columns(spark):
    schema = "doc_id long, text string, spans string, items int, n_words string"
    docs = [(1, "clean text", "s", 1, "n"), (2, "a short one", None, None, None), (3, None, None, None, None), (None, "", "", 2, "")]
    out = decontaminate.decontaminated(spark.createDataFrame(docs, schema), spark.createDataFrame(ITEMS, "item_id string, text string"))
    assert out.columns == ["doc_id", "text", "spans", "items", "n_words"] and sorted(map(tuple, out.collect()), key=str) == sorted((docs[0], docs[2], docs[3]), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert all(not r.spans and not r["items"] for r in decontaminate.contamination(docs, items).collect())
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id string, text string")).collect() == []
