"""A sink of loose files: rows (name, content) become files of a folder, with task and job commit.

A task writes its files into a staging folder of its own; what a failed or repeated task left there is never seen. When
all tasks are done, the job's commit moves the files of the tasks that count to their names and removes the staging
folders. Names are relative, with folders in them if need be; rows without content are counted and skipped.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(Arrow's file system, the path in it) of a path or URI."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its staging folder and the names in it."""

    folder: str
    names: list[str]
    skipped: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = file_system(self.path)
        folder = posixpath.join(root, STAGING, self.job, uuid.uuid4().hex)
        names, skipped = [], 0
        for row in iterator:
            if row["name"] is None or row["content"] is None:
                skipped += 1
                continue
            name = posixpath.normpath(row["name"])
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"not a name inside the folder: {row['name']}")
            to = posixpath.join(folder, name)
            fs.create_dir(posixpath.dirname(to), recursive=True)
            with fs.open_output_stream(to) as f:
                f.write(bytes(row["content"]))
            names.append(name)
        return Written(folder, names, skipped)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        done = [m for m in messages if m is not None]
        seen: set[str] = set()
        for m in done:
            for name in m.names:
                if name in seen:
                    self._clean(fs, root)
                    raise ValueError(f"two rows have the name {name}")
                seen.add(name)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if posixpath.basename(x.path) != STAGING:
                    (fs.delete_dir if x.type == pafs.FileType.Directory else fs.delete_file)(x.path)
        for m in done:
            for name in m.names:
                to = posixpath.join(root, name)
                fs.create_dir(posixpath.dirname(to), recursive=True)
                fs.move(posixpath.join(m.folder, name), to)
        self._clean(fs, root)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, "_SUCCESS")) as f:
            f.write(json.dumps({"saved": len(seen), "skipped": sum(m.skipped for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*file_system(self.path))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        own = posixpath.join(root, STAGING, self.job)
        if fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)
        top = posixpath.join(root, STAGING)
        if fs.get_file_info(top).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(top)):
            fs.delete_dir(top)


class NamedFiles(DataSource):
    """df.write.format("namedfiles"): columns name string, content binary."""

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, name: Column, content: Column, overwrite: bool = False) -> tuple[int, int]:
    """Writes each row's content to its name under `path`; (saved, skipped) as observed by the same job."""
    seen = Observation()
    rows = df.select(name.alias("name"), content.cast("binary").alias("content"))
    saved = F.count(F.when(F.col("name").isNotNull() & F.col("content").isNotNull(), 1))
    rows = rows.observe(seen, saved.alias("saved"), F.count(F.lit(1)).alias("all"))
    df.sparkSession.dataSource.register(NamedFiles)
    rows.write.format("namedfiles").mode("overwrite" if overwrite else "append").save(path)
    return seen.get["saved"], seen.get["all"] - seen.get["saved"]


def copy_files(listing: DataFrame, path: str, source: str = "path", name: str = "name", overwrite: bool = False) -> tuple[int, int]:
    """Copies the files that the column `source` lists to names under `path`, in tasks; a missing file counts as skipped."""

    @F.udf("binary")
    def content(p: str | None) -> bytes | None:
        if p is None:
            return None
        fs, at = file_system(p)
        if fs.get_file_info(at).type != pafs.FileType.File:
            return None
        with fs.open_input_file(at) as f:
            return f.read()

    return write_files(listing, path, F.col(name), content(F.col(source)), overwrite)
