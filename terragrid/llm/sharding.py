"""Sharding: append arrivals as small immutable shards, merge by size tiers, commit versioned manifests atomically.

A table is a folder. data/<name>/ holds Parquet files, each a shard, never changed once written; manifests/ holds one file
for each attempt, listing shards with their sizes; versions/<n> names the manifest of version n. A version is committed by
writing that name aside and moving it to versions/<n>, which fails if it exists: of two writers one wins, the other tries
again on top. The move is atomic (a hard link on a local file system, a rename without overwriting on HDFS and stores that
offer it), so no reader sees half a version, and a writer lost at any point leaves nothing that later ones meet. Shards
written by jobs that fail or lose are in no manifest and are never read. Readers take the largest version that is whole.

Compaction is size-tiered: shards below half the target size are sorted into tiers by powers of `fanout`; each tier of at
least `fanout` shards is merged by itself into files of at most about the target size, one task a file, without a shuffle. A row is thus
rewritten about log_fanout(target / arrival) times. The manifests list files, not rows: at 100 TB and 512 MB a file they
hold 200,000 entries, and they are all that the driver reads.

Nulls, repeated rows and very long texts are stored as they are. An empty arrival commits a version with no new rows.
Arrivals must have the table's columns (ValueError otherwise), in any order.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Output files of one merge job.
JOB_FILES = 200


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    id: str
    path: str
    bytes: int


class _Folder:
    """The few file operations a commit needs, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def sizes(self, name: str) -> dict[str, int]:
        at = self._at(name)
        return {f.getPath().getName(): f.getLen() for f in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file of ASCII text, whole or not at all; an error if it exists."""
        aside = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(aside), False)
        try:
            out.writeBytes(text)
        finally:
            out.close()
        try:
            self._move(aside, name)
        finally:
            self.fs.delete(self._at(aside), False)

    def _move(self, aside: str, name: str) -> None:
        hadoop, old, new = self.jvm.org.apache.hadoop.fs, self._at(aside), self._at(name)
        if self.fs.getScheme() == "file":  # its rename overwrites
            paths = [self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.String, 0)) for p in (new, old)]
            self.jvm.java.nio.file.Files.createLink(*paths)
        else:
            none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            none[0] = hadoop.Options.Rename.NONE
            hadoop.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration()).rename(old, new, none)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fanout: int = 4) -> None:
        self.spark, self.folder = spark, _Folder(spark, path)
        self.target, self.fanout = target_bytes, fanout

    def _versions(self) -> dict[int, bool]:
        """Versions that exist, and whether they are whole: an empty one is what a writer of a store without atomic moves may leave."""
        return {int(n): size > 0 for n, size in self.folder.sizes("versions").items() if n.isdecimal()}

    def version(self) -> int:
        """The largest committed version; 0 before the first."""
        return max((n for n, whole in self._versions().items() if whole), default=0)

    def _next(self) -> int:
        return max(self._versions(), default=0) + 1

    def manifest(self, version: int | None = None) -> tuple[T.StructType | None, list[Shard]]:
        """(schema, shards) of a version."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        held = json.loads(self.folder.read(f"manifests/{self.folder.read(f'versions/{version}').strip()}"))
        return T.StructType.fromJson(held["schema"]), [Shard(**s) for s in held["shards"]]

    def commit(self, version: int, schema: T.StructType, shards: list[Shard]) -> None:
        """Makes `shards` the table's contents as `version`, or raises Conflict if that version exists."""
        name = f"{version}-{uuid.uuid4().hex}.json"
        self.folder.create(f"manifests/{name}", json.dumps({"schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}))
        try:
            self.folder.create(f"versions/{version}", name + "\n")
        except Exception as e:
            self.folder.delete(f"manifests/{name}")
            raise Conflict(f"version {version} was committed by another writer") from e

    def _write(self, df: DataFrame) -> list[tuple[str, int]]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.path}/{name}")
        return [(f"{name}/{f}", n) for f, n in sorted(self.folder.sizes(name).items()) if f.endswith(".parquet")]

    def append(self, df: DataFrame, tries: int = 5) -> int:
        """Adds the rows of `df` as new shards; returns the version committed."""
        files = None
        for _ in range(tries):
            version = self._next()
            schema, shards = self.manifest()
            if schema is None:
                schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
            if {f.name: f.dataType for f in df.schema.fields} != {f.name: f.dataType for f in schema.fields}:
                raise ValueError(f"an arrival needs the columns {schema.simpleString()}")
            files = files or self._write(df.select(*[F.col(f"`{f.name}`") for f in schema.fields]))
            try:
                self.commit(version, schema, shards + [Shard(f"{version}.{i}", p, n) for i, (p, n) in enumerate(files)])
                return version
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers were faster")

    def tier(self, size: int) -> int | None:
        """0 for the largest shards that are still merged; None for those that are large enough."""
        return None if size >= self.target / 2 else int(math.log(self.target / 2 / max(size, 1), self.fanout))

    def compact(self, tries: int = 5) -> int:
        """Merges every tier that is full, the smallest shards first, and commits; returns the version (unchanged if none was).

        Where another writer commits first, the merged files are committed on top if their sources are still listed;
        otherwise the merge starts anew.
        """
        files: list[tuple[str, int]] = []
        merged: set[str] = set()
        for _ in range(tries):
            schema, shards = self.manifest()
            if not merged or not merged <= {s.id for s in shards}:
                tiers: dict[int, list[Shard]] = {}
                for s in shards:
                    if (t := self.tier(s.bytes)) is not None:
                        tiers.setdefault(t, []).append(s)
                full = [tiers[t] for t in sorted(tiers, reverse=True) if len(tiers[t]) >= self.fanout]
                if not full:
                    return self.version()
                files, merged = self._merge(schema, [b for tier in full for b in self._bins(tier)]), {s.id for tier in full for s in tier}
            version = self._next()
            try:
                self.commit(version, schema, [s for s in shards if s.id not in merged] + [Shard(f"{version}.{i}", p, n) for i, (p, n) in enumerate(files)])
                return version
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers were faster")

    def _bins(self, shards: list[Shard]) -> list[list[Shard]]:
        """Consecutive shards of about equal bytes together, near the target size."""
        total = sum(s.bytes for s in shards)
        goal, at = total / max(1, round(total / self.target)), 0.0
        bins: list[list[Shard]] = []
        for s in shards:
            if not bins or at >= goal * len(bins):
                bins.append([])
            bins[-1].append(s)
            at += s.bytes
        return bins

    def _merge(self, schema: T.StructType, bins: list[list[Shard]]) -> list[tuple[str, int]]:
        """Files of the bins, one task a bin. A union of single partitions would otherwise become one partition itself."""
        conf, key = self.spark.conf, "spark.sql.unionOutputPartitioning"
        read, files, before = self.spark.read.schema(schema), [], conf.get(key)
        conf.set(key, "false")
        try:
            for i in range(0, len(bins), JOB_FILES):
                parts = [read.parquet(*[f"{self.folder.path}/{s.path}" for s in b]).coalesce(1) for b in bins[i : i + JOB_FILES]]
                merged = parts[0]
                for p in parts[1:]:
                    merged = merged.unionAll(p)
                files += self._write(merged)
        finally:
            conf.set(key, before)
        return files

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last `keep`, and the shards that only they hold. Not for use while older versions are read."""
        versions = sorted(n for n, whole in self._versions().items() if whole)
        old, kept = versions[:-keep], versions[-keep:]
        live = {s.path for v in kept for s in self.manifest(v)[1]}
        for path in {s.path for v in old for s in self.manifest(v)[1]} - live:
            self.folder.delete(path)
        for v in old:
            self.folder.delete(f"manifests/{self.folder.read(f'versions/{v}').strip()}")
            self.folder.delete(f"versions/{v}")

    def listing(self, version: int | None = None) -> DataFrame:
        """(shard, file, bytes) of a version, one row a file, read by the executors from its manifest."""
        version = self.version() if version is None else version
        name = self.folder.read(f"versions/{version}").strip()
        held = self.spark.read.schema("shards array<struct<id string, path string, bytes long>>").option("multiLine", True).json(f"{self.folder.path}/manifests/{name}")
        return held.select(F.inline("shards")).select(F.col("id").alias("shard"), F.substring_index("path", "/", -1).alias("file"), "bytes")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the hidden column _metadata of file sources."""
        schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("nothing was committed yet")
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{s.path}" for s in shards])


def compacted(arrivals: list[DataFrame], path: str, target_bytes: int = 64 << 20, fanout: int = 4) -> ShardedTable:
    """A table at `path` of all arrivals, appended and compacted one by one; superseded shards are deleted."""
    table = ShardedTable(arrivals[0].sparkSession, path, target_bytes, fanout)
    for df in arrivals:
        table.append(df)
        table.compact()
        table.vacuum()
    return table
