"""The native operators against their SQL on whole tables, and their corner cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from terragrid.llm import mixing, url_filter
from terragrid.llm.queries import ORACLES, QUERIES, RULES

DOCS = "doc_id long, text string, source string, size string, key string, id string"


def sql(name, **tables):
    con = duckdb.connect()
    for t, v in tables.items():
        con.register(t, v.toArrow())
    return answers(con, name)


def answers(con, name):
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def same(df, want):
    rows = [sorted(repr(sorted(r.items())) for r in t) for t in ([r.asDict() for r in df.collect()], want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_whole_tables(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    same(QUERIES[name](spark, sf), answers(con, name))


def test_mix_of_skewed_null_and_repeated_documents(spark):
    rows = [(i, "w " * (i % 17), f"s{min(i % 40, 5)}", None, "a", "b") for i in range(400)]
    rows += [(i, "v " * 5, None, "x", None, None) for i in range(20)] + [(7, "w " * 7, "s5", None, None, None)] * 3
    rows += [(None, "null id", "s1", None, None, None), (None, None, "empty", None, None, None), (500, "one long " * 3000, "s2", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).drop("source")
    same(out, sql("op6_fair_mix", documents=df.select("doc_id", "text", "source")))
    got = mixing.mix(df).groupBy("source", "target", "source_size").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    for r in got:
        assert r.over <= 0 and r.target <= 3 * r.source_size and abs(r.taken - r.target) <= 6000 + 1
    again = mixing.mix(df.repartition(7)).drop("source")
    same(again, [r.asDict() for r in out.collect()])
    assert mixing.mix(df.limit(0)).count() == 0
    finish = [math.inf if r.finish is None else r.finish for r in out.collect()]
    assert finish == sorted(finish) and all((r.finish is None) == (r.taken == 0) for r in out.collect())
    assert mixing.mixed_documents(df).columns == df.columns


def test_mixed_documents_follow_the_mix(spark):
    """Columns named like the operator's own pass through, and partitions follow one another by finish time."""
    names = "doc_id long, text string, source string, _size int, _copy int, size int, finish string, id int, row int, d_id int"
    rows = [(i, "w " * (i % 17), f"s{i % 3}", 7, 8, 9, "f", i, 3, 4) for i in range(300)]
    df = spark.createDataFrame(rows, names)
    out = mixing.mixed_documents(df).select(F.spark_partition_id().alias("part"), "*").collect()
    assert {tuple(r)[1:] for r in out} <= set(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    sizes, held = {}, {}
    for r in out:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.doc_id % 17
        words = len(r.text.split())
        sizes.setdefault(r.source, []).append(words)
    assert held == {i: n for i, n in taken.items() if n}
    # at any point of the mix the sources stand to each other as their targets do
    target = {r.source: r.target for r in mixing.mix(df).collect()}
    done = dict.fromkeys(target, 0)
    for n, r in enumerate(sorted(out, key=lambda r: r.part), 1):  # rows of a partition keep their order
        done[r.source] += r.doc_id % 17
        if n % 50 == 0:
            shares = [done[s] / target[s] for s in target]
            assert max(shares) - min(shares) < 0.06


def test_urls_of_all_kinds(spark):
    urls = ["http://a.com/en/7", "http://EXAMPLE.com/en/77?q", "https://x.example.com/en/", "net/de/", "x://net/de/", "x://a.example.net/de/8#a", "x://notexample.net/de/8", "http://org/es/a", "a://b://org/es/", "", None,
            "http://www.spam-farm.example.org", "http://xspam-farm.example.org/", "://", "http:///en/", "http://.com/en/", "http://com?/en/", "http://com/EN/", "http://ÄB.com/en/"]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string, verdict string")
    same(url_filter.judge_urls(df, RULES, [f"{n}.example.{t}" for n in ("cheap-pills", "spam-farm") for t in ("com", "net", "org")]), sql("op10_url_cascade", pages=df.select("page_id", "url")))
    assert url_filter.judge_urls(df.limit(0), RULES, ["a.b"]).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("crc32(key) % 20 = 3")
    cascade = url_filter.build_cascade(listed.unionAll(listed), universe.unionAll(spark.createDataFrame([(None,)], "key string")))
    got = universe.where(cascade.contains(F.col("key")))
    assert got.exceptAll(listed).count() == 0 and listed.exceptAll(got).count() == 0
    assert 1 < len(cascade.levels) and cascade.bits < 16 * listed.count()
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, max_bytes=64)
