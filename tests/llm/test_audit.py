"""The filter audit against a plain version of its definition."""

import re
from itertools import permutations

from terragrid.llm import audit, queries
from tests.oracle import differences


def brute(docs, labels):
    """Rows of (id, text, source) documents and (id, quality, toxic) labels."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and least[text] < i,
        }
        fails.append((i, source or "", {k for k, v in f.items() if v}))
    out = []
    for part in {s for _, s, _ in fails}:
        own = [(i, f) for i, s, f in fails if s == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                redundant = sum(letter in f for _, f in gone)
                left = [x for x in left if letter not in x[1]]
                gone = gone + removed
                shapley[letter] += len(removed)
                unique = sum(f == {letter} for _, f in own)
                rows.append([part, "".join(order), step, len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), letter])
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def test_query_is_the_definition_and_the_sql(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = brute(docs, labels)
    assert sorted(map(tuple, queries.op13_filter_audit(spark, sf).collect())) == want
    assert differences(spark, queries.op13_filter_audit, queries.ORACLES["op13_filter_audit"]) == ""


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and rows, copies over sources, repeated and null labels, other columns."""
    long = " ".join(f"w{i}" for i in range(500))
    docs = [(1, None, None), (2, "", ""), (3, "", "s"), (None, "", "s"), (None, None, "s"), (4, long, "s"), (4, long, "s"), (5, long, "t"), (6, long, "s"), (6, long, "s"), (7, long.upper(), "t")]
    docs += [(8, "x " * 100_000, "s"), (9, "50% & more", None), (9, "other text", "s"), (10, long + " ÄÖ", "t"), (11, " " * 10, "t")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1), (9, 0, 0), (3, 1, 1)]
    df = spark.createDataFrame([(*r, "a", 7, 8) for r in docs], "doc_id long, text string, source string, part string, mask int, n int")
    out = audit.audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)


def test_hot_group_of_copies(spark):
    docs = [(i, "same text", f"s{i % 3}") for i in range(3000)]
    out = audit.audited(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == brute(docs, [])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audited(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
