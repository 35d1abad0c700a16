"""Sharded tables: contents, sizes, versions, conflicts and lost jobs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from terragrid.llm.queries import op1_sharding
from terragrid.llm.sharding import Conflict, ShardedTable, compacted

SCHEMA = "doc_id long, text string, shard string, version string, file string"


def new_path():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def rows(df):
    return sorted(map(repr, df.collect()))


def frame(spark, low, high):
    return spark.createDataFrame([(i if i % 9 else None, f"text {i} " * 50, None, "x", "y") for i in range(low, high)], SCHEMA)


def test_whole_table(spark, sf):
    out = op1_sharding(spark, sf).collect()
    docs = {r.doc_id: len(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted((r.doc_id, r.n_bytes) for r in out) == sorted(docs.items())
    sizes = {r.shard: r.shard_bytes for r in out}
    assert len({r.version for r in out}) == 1 and out[0].version >= 4
    assert all(0 < n < 1.5 * (64 << 20) for n in sizes.values()) and len(sizes) < 16


def test_appends_and_merges_keep_all_rows(spark):
    arrivals = [frame(spark, i * 40, i * 40 + 40).repartition(3) for i in range(6)]
    table = compacted(arrivals, new_path(), target_bytes=30_000, fanout=3)
    want = arrivals[0]
    for a in arrivals[1:]:
        want = want.unionAll(a)
    assert rows(table.read()) == rows(want)
    _, shards = table.manifest()
    assert len(shards) < 18 and all(s.bytes < 2.5 * 30_000 for s in shards)
    tiers = [table.tier(s.bytes) for s in shards]
    assert all(tiers.count(t) < 3 for t in set(tiers) - {None})


def test_versions_are_immutable(spark):
    table = ShardedTable(spark, new_path(), 1 << 20, 2)
    assert table.version() == 0 and table.manifest() == (None, [])
    with pytest.raises(ValueError):
        table.read()
    a, b = frame(spark, 0, 10).coalesce(1), frame(spark, 10, 30).coalesce(1)
    assert (table.append(a), table.append(b), table.compact(), table.compact()) == (1, 2, 3, 3)
    assert rows(table.read(1)) == rows(a)
    assert rows(table.read(2)) == rows(table.read(3)) == rows(a.unionAll(b))
    table.vacuum()
    assert rows(table.read()) == rows(a.unionAll(b))
    with pytest.raises(ValueError):
        table.append(a.drop("file"))
    assert table.append(a.select(*reversed(a.columns))) == 4


def test_conflicts_and_lost_jobs(spark):
    path = new_path()
    one, two = ShardedTable(spark, path), ShardedTable(spark, path)
    a = frame(spark, 0, 10)
    one.append(a)
    schema, shards = two.manifest()
    one.append(a)
    with pytest.raises(Conflict):
        two.commit(2, schema, shards)
    assert one.version() == 2 and len(os.listdir(f"{path}/manifests")) - sum(f.startswith(".") for f in os.listdir(f"{path}/manifests")) == 2
    two._write(a)  # a job that ended before its commit
    assert rows(one.read()) == rows(a.unionAll(a))
    assert two.append(a) == 3


def test_empty_arrivals(spark):
    empty = frame(spark, 0, 1).limit(0)
    table = compacted([empty, empty, frame(spark, 0, 5), empty], new_path())
    assert table.read().count() == 5


def test_lost_writers_leave_the_table_whole(spark):
    path = new_path()
    table = ShardedTable(spark, path, 1 << 20, 2)
    a = frame(spark, 0, 10).coalesce(1)
    table.append(a)
    open(f"{path}/versions/.0a", "w").close()  # lost while writing aside
    assert table.append(a) == 2
    open(f"{path}/versions/3", "w").close()  # lost while writing in place, on a store without atomic moves
    assert table.version() == 2 and rows(table.read()) == rows(a.unionAll(a))
    assert table.append(a) == 4 and table.compact() == 5
    assert rows(table.read()) == rows(a.unionAll(a).unionAll(a))
    table.vacuum()
    assert rows(table.read()) == rows(a.unionAll(a).unionAll(a))
    assert sorted(r.file for r in table.listing().collect()) == sorted(s.path.rsplit("/", 1)[1] for s in table.manifest()[1])


def test_compaction_goes_on_after_a_conflict(spark, monkeypatch):
    path = new_path()
    table, other = ShardedTable(spark, path, 1 << 20, 2), ShardedTable(spark, path, 1 << 20, 2)
    a = frame(spark, 0, 10).coalesce(1)
    table.append(a)
    table.append(a)
    commit, calls = ShardedTable.commit, []

    def late(self, version, schema, shards):
        calls.append(version)
        if len(calls) == 1:
            other.append(a)
        commit(self, version, schema, shards)

    monkeypatch.setattr(table, "commit", late.__get__(table))
    assert table.compact() == 4 and calls == [3, 4]
    assert rows(table.read()) == rows(a.unionAll(a).unionAll(a)) and len(table.manifest()[1]) == 2


def test_tiers_are_merged_by_themselves(spark):
    table = ShardedTable(spark, new_path(), 1 << 20, 2)
    schema = frame(spark, 0, 1).schema
    small, large = frame(spark, 0, 3).coalesce(1), frame(spark, 0, 3000).select("doc_id", F.concat_ws("", F.lit("x"), F.expr("sha2(cast(doc_id as string), 512)")).alias("text"), "shard", "version", "file").coalesce(1)
    for df in (small, large, small, large):
        table.append(df)
    tiers = {table.tier(s.bytes) for s in table.manifest()[1]}
    assert len(tiers) == 2
    table.compact()
    assert len(table.manifest()[1]) == 2 and table.manifest()[0] == schema


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "long text " * 3_000_000, None, "x", "y"), (2, None, None, None, None)], SCHEMA)
    table = compacted([df, df], new_path(), fanout=2)
    assert sorted(table.read().selectExpr("doc_id", "length(text)").collect()) == [(1, 30_000_000)] * 2 + [(2, None)] * 2
