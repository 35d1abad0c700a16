"""Session helpers: the shared folder, lineage cuts, and slicing of Arrow batches by bytes."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are worked off in slices of about so many bytes of text, so a worker's memory stays flat.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a new temporary folder if all runs in this process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="terragrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: the rows outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again, for loops of joins: a checkpoint keeps its plan's estimated
    size, joins multiply it, and the digits of that number double with each round until planning takes for ever."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chars(df: DataFrame, text_col: str = "text") -> int:
    """Sum of text lengths; sizes blocks and partitions. One number reaches the driver."""
    return df.agg(F.sum(F.length(text_col))).first()[0] or 0


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive row ranges holding at most `limit` bytes of `column`; a longer single row is a slice of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def free_memory() -> None:
    """Gives back to the system what this process has freed: a reused Python worker would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function of batches, that frees the worker's memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return wrapped


def freed(f: Callable) -> Callable:
    """`f`, a function of one or two tables for groups or cogroups, that frees the worker's memory after each."""

    def one(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            free_memory()

    def two(t: pa.Table, u: pa.Table) -> pa.Table:
        try:
            return f(t, u)
        finally:
            free_memory()

    return one if f.__code__.co_argcount == 1 else two
