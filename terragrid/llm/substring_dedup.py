"""Substring dedup by a compacted De Bruijn graph of word n-grams.

Each window of n words is an edge from the node of its first n - 1 words to that of its last n - 1. Edges that occur in
two documents or more are kept. At an edge whose occurrences differ in the word before or after it (or lack one), the
graph branches; between branches all occurrences of a path run alike, so it is compacted into one row: a 128-bit
cryptographic digest of the bytes of its words, read from the text at its source coordinates (document and first word of
each occurrence in a block), and its length. A join by digest gives each path its source, the smallest id that holds it:
only spans with the same words meet. Words covered by a path that a document with a smaller id holds are removed.

Edges are not sent one by one. Documents are dealt to blocks by id and text, once; the exchange is reused by each pass over the
texts. First, blocks exchange the least (n - 5)-gram hash of each window, about a quarter as many values as windows, and
windows whose least hash occurs in one document only are dropped. What is left is exchanged as sorted arrays, merged
within the block, so a window that all documents hold is sent once a block. No task gathers a key's documents.

Nulls: a null text has no words; a null id is no source, but its repeats of others are removed. Texts of fewer than n
words lose nothing. Rows with the same id are one document: they are no sources for each other. Empty tables give empty
results. A wrong removal needs two spans of one digest, which is out of reach. A repeat can be missed only where two
windows have an equal 64-bit hash, or two words beside a path's ends 46 equal bits (64 would shuffle over 4 times the
input), so that the path runs on too far: a chance of 1.4e-14 for each path's end.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrid.llm.shared import freed, text_chars
from terragrid.llm.text import U, column, grams, mix, word_hashes, words

#: Characters of a block of documents, and of text whose hashes meet in one part.
BLOCK_CHARS, PART_CHARS = 1 << 23, 1 << 24
_PARTS = "part int, block int, data binary"
#: The order of a block's documents, alike in each pass; rows equal in both are equal in text.
_ORDER = [("id", "ascending"), ("tkey", "ascending")]


class _Block:
    """Words and windows of a block of documents."""

    def __init__(self, docs: pa.Table) -> None:
        self.off, self.words = words(column(docs, "text"))
        self.hash = word_hashes(self.words)
        ids = column(docs, "id").dictionary_encode()
        self.code = np.asarray(ids.indices.fill_null(len(ids.dictionary))).astype(np.int64)

    def doc_at(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1

    def least(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(least hash of the shorter grams in each window of n words, position of the window)."""
        m = max(1, n - 5)
        _, at = grams(self.hash, self.off, n)
        if not len(at):
            return np.zeros(0, U), at
        short, where = grams(self.hash, self.off, m)
        dense = np.zeros(len(self.hash), U)
        dense[where] = short
        low = dense[at]
        for i in range(1, n - m + 1):
            low = np.minimum(low, dense[at + i])
        return low, at

    def context(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """Hashes of the words before and after each window, each as odd 32 and 16 bits; 0 at a text's ends."""
        doc, out = self.doc_at(at), []
        word = np.append(mix(self.hash), U(0))
        for inside, beside in ((at > self.off[doc], at - 1), (at + n < self.off[doc + 1], np.minimum(at + n, len(self.hash)))):
            x = word[beside]
            out += [np.where(inside, part | part.dtype.type(1), part.dtype.type(0)) for part in (x.astype(np.uint32), (x >> U(32)).astype(np.uint16))]
        return out


def _groups(keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def _merged(key: np.ndarray, doc: np.ndarray, *context: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, whether several documents hold them, and contexts (0 where they differ)."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    at = _groups(key)
    if not len(at):
        return [key, np.zeros(0, np.uint8), *context]
    many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    out = [key[at], many.astype(np.uint8)]
    for c in context:
        low = np.minimum.reduceat(c[order], at)
        out.append(np.where(low == np.maximum.reduceat(c[order], at), low, c.dtype.type(0)))
    return out


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns' bytes, one after the other, compressed; of the first one, ascending keys, the differences."""
    keys = np.diff(columns[0], prepend=U(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in (keys, *columns[1:])))


def _dealt(block: int, parts: int, columns: list[np.ndarray]) -> pa.Table:
    """One row for each part that holds keys of the block; keys ascend."""
    part = (columns[0] % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    at = [*_groups(part), len(part)]
    data = [_packed([c[a:b] for c in columns]) for a, b in zip(at[:-1], at[1:])]
    return pa.table({"part": pa.array(part[at[:-1]].astype(np.int32)), "block": pa.array(np.full(len(data), block, np.int32)), "data": pa.array(data, pa.binary())})


def _read(data: list[bytes], kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns that _dealt or _answers wrote, and how many keys each row has."""
    data = [zstandard.ZstdDecompressor().decompress(d) for d in data]
    width = sum(np.dtype(k).itemsize for k in kinds)
    sizes = np.array([len(d) // width for d in data], np.int64)
    out = []
    shift = np.zeros(len(data), np.int64)
    for k in kinds:
        item = np.dtype(k).itemsize
        out.append(np.concatenate([np.frombuffer(d, k, n, s) for d, n, s in zip(data, sizes, shift)] or [np.zeros(0, k)]))
        shift = shift + sizes * item
    ends = np.cumsum(sizes)
    out[0] = np.concatenate([np.cumsum(x, dtype=U) for x in np.split(out[0], ends[:-1])]) if len(data) else out[0]
    return out, sizes


def _answers(blocks: list[int], sizes: np.ndarray, keep: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """To each block the kept rows of its part."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = []
    for a, b in zip(ends[:-1], ends[1:]):
        k = keep[a:b]
        data.append(_packed([c[a:b][k] for c in columns]) if k.any() else b"")
    full = [i for i, d in enumerate(data) if d]
    return pa.table({"block": pa.array([blocks[i] for i in full], pa.int32()), "data": pa.array([data[i] for i in full], pa.binary())})


def _ranked(table: pa.Table) -> pa.Table:
    """A reducer's rows in the order of their blocks."""
    return table.sort_by("block")


def paths(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """a long, b long (digest), id, tkey long, start long, n_words long: an occurrence of a path of repeated edges each.

    `docs` has block, id, tkey and text.
    """
    id_type = docs.schema["id"].dataType
    grouped = docs.groupBy("block")

    def seeds(t: pa.Table) -> pa.Table:
        b = _Block(t)
        low, at = b.least(n)
        doc = b.code[b.doc_at(at)] if len(at) else at
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        return _dealt(t["block"][0].as_py(), parts, _merged(low[new], doc[new]))

    def shared_seeds(t: pa.Table) -> pa.Table:
        t = _ranked(t)
        (key, many), sizes = _read(t["data"].to_pylist(), [U, np.uint8])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        held = (count > 1) | (np.bincount(inverse, many, len(count)) > 0)
        return _answers(t["block"].to_pylist(), sizes, held[inverse], [key])

    def edges(t: pa.Table, answer: pa.Table) -> pa.Table:
        (known,), _ = _read(answer["data"].to_pylist(), [U])
        if not t.num_rows or not len(known):
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        b = _Block(t)
        low, _ = b.least(n)
        edge, at = grams(b.hash, b.off, n)
        hit = _member(low, np.sort(known))
        edge, at = edge[hit], at[hit]
        return _dealt(t["block"][0].as_py(), parts, _merged(edge, b.code[b.doc_at(at)], *b.context(at, n)))

    def shared_edges(t: pa.Table) -> pa.Table:
        t = _ranked(t)
        (key, many, *context), sizes = _read(t["data"].to_pylist(), [U, np.uint8, np.uint32, np.uint16, np.uint32, np.uint16])
        order = np.argsort(key, kind="stable")
        at = _groups(key[order])
        if not len(at):
            return _answers([], sizes[:0], np.zeros(0, bool), [key])
        count = np.diff(np.append(at, len(key)))
        held = (count > 1) | (np.maximum.reduceat(many[order], at) > 0)
        cut = np.zeros(len(at), np.uint8)
        for bit, c in zip((1, 1, 2, 2), context):
            low = np.minimum.reduceat(c[order], at)
            cut |= (((low != np.maximum.reduceat(c[order], at)) | (low == 0)) * bit).astype(np.uint8)
        group = np.empty(len(key), np.int64)
        group[order] = np.repeat(np.arange(len(at)), count)
        return _answers(t["block"].to_pylist(), sizes, held[group], [key, cut[group]])

    def compact(t: pa.Table, answer: pa.Table) -> pa.Table:
        (known, cut), _ = _read(answer["data"].to_pylist(), [U, np.uint8])
        names = ["a", "b", "block", "n_words", "source", "places"]
        if not t.num_rows or not len(known):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), column(t, "id").type, pa.binary())], names)
        t = t.sort_by(_ORDER)
        order = np.argsort(known)
        known, cut = known[order], cut[order]
        b = _Block(t)
        edge, at = grams(b.hash, b.off, n)
        hit = _member(edge, known)
        edge, at = edge[hit], at[hit]
        flag = cut[np.searchsorted(known, edge)]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (flag[:-1] & 2 > 0) | (flag[1:] & 1 > 0)
        head = np.flatnonzero(first)
        start = at[head]
        size = np.diff(np.append(head, len(at))) + n - 1
        doc = b.doc_at(start)
        x, y = _digests(b.words, start, size)
        order = np.lexsort((doc, y, x))
        x, y, size, doc, start = x[order], y[order], size[order], doc[order], start[order]
        at = _groups(x) if len(x) < 2 else np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        place = np.stack([doc, start - b.off[doc]], axis=1).astype("<u4")
        places = [place[i:j].tobytes() for i, j in zip(at, [*at[1:], len(x)])]
        ids = column(t, "id").take(pa.array(doc[at]))  # the smallest of the block, as documents are in order
        return pa.table([pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(np.full(len(at), t["block"][0].as_py(), np.int32)), pa.array(size[at]), ids, pa.array(places, pa.binary())], names)

    asked = grouped.applyInArrow(freed(seeds), _PARTS).groupBy("part").applyInArrow(freed(shared_seeds), "block int, data binary")
    asked = grouped.cogroup(asked.groupBy("block")).applyInArrow(freed(edges), _PARTS).groupBy("part").applyInArrow(freed(shared_edges), "block int, data binary")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n_words", T.LongType()), T.StructField("source", id_type), T.StructField("places", T.BinaryType())])
    return grouped.cogroup(asked.groupBy("block")).applyInArrow(freed(compact), schema)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among `known` (ascending, not empty)."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _digests(flat: pa.Array, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of the words flat[start:start+size] of each span."""
    text = lambda x: pa.scalar(x, pa.large_string())
    spaced = pc.binary_join_element_wise(flat.cast(pa.large_string()), text(""), text(" "))
    if not len(start):
        return np.zeros(0, U), np.zeros(0, U)
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = memoryview(spaced.buffers()[2])
    joined = b"".join(hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(ends[start].tolist(), ends[start + size].tolist()))
    both = np.frombuffer(joined, "<u8").reshape(-1, 2).astype(U)
    return both[:, 0].copy(), both[:, 1].copy()


def _dealt_documents(df: DataFrame, id_col: str, text_col: str, carried: list[str]) -> tuple[DataFrame, int]:
    """(block, id, tkey, text, c0, c1, ... of `df`, number of parts); tkey puts texts with the same id in order."""
    chars = text_chars(df, text_col)
    blocks, parts = max(12, math.ceil(chars / BLOCK_CHARS)), max(8, math.ceil(chars / PART_CHARS))
    # rows of one id, null too, are dealt by their texts, equal rows by where they were read: no sources for each other, they need not meet
    block = F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block")
    docs = df.select(block, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    return docs, parts


def deduplicate(df: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space) and the `carried` columns of each row of `df`.

    `as_is`: a text that loses nothing is kept as it is, null included.
    """
    docs, parts = _dealt_documents(df, id_col, text_col, list(carried))
    # a path's smallest id, added up before the shuffle; one row a block and path is then joined with one row a path
    found = paths(docs, n, parts)  # not written: in one plan the exchange of texts is reused, and takes room once
    least = found.where("source IS NOT NULL").groupBy("a", "b").agg(F.min("source").alias("least"))
    found = found.join(least, ["a", "b"]).select("block", "n_words", F.col("least").alias("source"), "places")
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    fields += [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carried)]

    def strike(t: pa.Table, marks: pa.Table) -> pa.Table:
        t = t.sort_by(_ORDER)
        ids = t["id"].to_pylist()
        at: dict[int, list[tuple[int, int]]] = {}
        for m, source, places in zip(*(marks[c].to_pylist() for c in ("n_words", "source", "places"))):
            for doc, start in np.frombuffer(places, "<u4").reshape(-1, 2).tolist():
                if ids[doc] is None or source < ids[doc]:
                    at.setdefault(doc, []).append((start, m))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(t["text"].to_pylist()):
            w = (text or "").encode().split()
            n_words.append(len(w))
            left = w
            if i in at:
                keep = bytearray(b"\1") * len(w)
                for s, m in at[i]:
                    keep[s : s + m] = bytes(m)
                left = list(itertools.compress(w, keep))
            n_removed.append(len(w) - len(left))
            kept.append(text if as_is and len(left) == len(w) else b" ".join(left).decode())
        cols = [column(t, "id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.table([*cols, *[column(t, f"c{i}") for i in range(len(carried))]], [f.name for f in fields])

    out = docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(freed(strike), T.StructType(fields))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)])


def deduplicated(df: DataFrame, n: int = 13) -> DataFrame:
    """The rows of `df` with their repeats of earlier documents removed; untouched texts stay as they are."""
    others = tuple(c for c in df.columns if c not in ("doc_id", "text", "n_chars"))
    out = deduplicate(df, n, carried=others, as_is=True)
    out = out.toDF("id", "words", "removed", "left", *[f"c{i}" for i in range(len(others))])
    from_ = {"doc_id": F.col("id"), "text": F.col("left"), "n_chars": F.length("left").cast("bigint")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return out.select(*[from_[c].alias(c) for c in df.columns])
