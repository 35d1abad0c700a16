"""Importance resampling towards a target set, by a dictionary of distinct n-gram features.

A feature is a run of 1 to n consecutive words, joined by one space; its bucket is its bytes' CRC-32 modulo the number of
buckets. The dictionary is built over the whole corpus: tasks count the distinct features of a window of words, and send
the strings, sorted and compressed, to the part of the dictionary that a hash of their words names; there equal strings of
all windows meet, are counted and hashed once, and only sums by bucket leave a part. A hot feature reaches its part once a
window, however often it occurs. The same is done with the target's texts, and a bucket's gain is the logarithm of its
share in the target over its share in the corpus.

The gains (one number a bucket, a stated bound) then join each document's feature counts. The buckets of a document's
features are told from the CRCs of its distinct words, as the CRC of a joined string follows from those of its parts: no
feature is spelled or hashed again, and neither texts nor buckets are shuffled.

Documents are drawn without replacement by the Gumbel trick: the highest of weight plus noise, where the noise depends on
seed and id alone. Ranks come from a range sort whose last key is the row's place, so that equal rows need not meet.

Nulls: a null text has no features; a null id takes part with the noise of the empty id. Repeated rows are counted, weighed
and drawn each; among equal score and id their order is that of the input. Empty tables give empty results; an empty
target leaves gains that all follow from its zero counts. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terragrid.llm.shared import cut_lineage, freed, freeing, slices, text_chars
from terragrid.llm.text import U, column, lowered_words, mix, word_hashes

#: Words of a window whose distinct features are counted together (below 2^21, as three word codes share 63 bits), bytes of
#: text that a slice holds, characters of the corpus for each part of the dictionary, and the most buckets whose gains are sent.
WINDOW, SLICE, PART_CHARS, MAX_BUCKETS = 2_000_000, 7 << 20, 12 << 20, 1 << 20
#: Strings that are hashed at a time.
SPELLED = 1 << 16


def _apply(tables: np.ndarray, x: np.ndarray, which: np.ndarray | int = 0) -> np.ndarray:
    """The linear maps of 32 bits in `tables` (maps, 4, 256), one for each byte's value, of `x`."""
    base = np.asarray(which, np.int64) * 1024
    flat = tables.reshape(-1)
    out = flat[base + (x & 255)]
    for i in range(1, 4):
        out = out ^ flat[base + i * 256 + ((x >> (8 * i)) & 255)]
    return out


@lru_cache(maxsize=1024)
def _shift(n: int) -> np.ndarray:
    """(1, 4, 256): what n more bytes make of the CRC-32 of what precedes them; their own CRC is then added by exclusive or."""
    if n == 0:
        return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])[None]
    half = _shift(n // 2)
    out = _apply(half, half)
    if n % 2:
        byte = np.array([~zlib.crc32(bytes([i ^ 255])) & 0xFFFFFFFF ^ 0xFFFFFF for i in range(256)], np.uint32)
        out = (out >> np.uint32(8)) ^ byte[out & 255]
    return out


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


class _Window:
    """The features that start at words lo to hi of a slice; runs do not leave their text."""

    def __init__(self, off: np.ndarray, flat: pa.Array, lo: int, hi: int, n: int) -> None:
        coded = flat[lo : hi + n - 1].dictionary_encode()
        order = np.asarray(pc.array_sort_indices(coded.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.vocabulary = coded.dictionary.take(pa.array(order))
        self.codes = rank[np.asarray(coded.indices)]
        self.text = np.searchsorted(off, np.arange(lo, lo + len(self.codes)), side="right") - 1
        self.starts = hi - lo

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of each run of n words; codes order runs as their words do."""
        m = min(self.starts, len(self.codes) - n + 1)
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = self.codes[:m]
        for i in range(1, n):
            code = code * len(self.vocabulary) + self.codes[i : m + i]
        inside = self.text[:m] == self.text[n - 1 : m + n - 1]
        return self.text[:m][inside], code[inside]

    def words(self, code: np.ndarray, n: int) -> list[np.ndarray]:
        out = []
        for _ in range(n):
            code, last = np.divmod(code, len(self.vocabulary))
            out.append(last)
        return out[::-1]

    def lines(self, code: np.ndarray, n: int) -> pa.Array:
        """The runs as strings, each with a line's end."""
        *words, last = self.words(code, n)
        ended = pc.binary_join_element_wise(self.vocabulary, _text(""), _text("\n"))
        parts = [*(self.vocabulary.take(pa.array(w)) for w in words), ended.take(pa.array(last))]
        return pc.binary_join_element_wise(*parts, _text(" ")) if n > 1 else parts[0]

    def digests(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, CRC-32) of each run of 1, 2, ... n words."""
        words = self.vocabulary.cast(pa.large_binary()).to_pylist()
        alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        after = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
        sizes, which = np.unique(np.fromiter(map(len, words), np.int64, len(words)) + 1, return_inverse=True)
        tables = np.concatenate([_shift(int(k)) for k in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
        crc = alone[self.codes]
        for size in range(1, n + 1):
            m = min(self.starts, len(self.codes) - size + 1)
            if m <= 0:
                return
            if size > 1:
                last = self.codes[size - 1 : m + size - 1]
                crc = _apply(tables, crc[:m], which[last]) ^ after[last]
            inside = self.text[:m] == self.text[size - 1 : m + size - 1]
            yield self.text[:m][inside], crc[:m][inside]


def _windows(texts: pa.Array, n: int) -> Iterator[_Window]:
    off, flat = lowered_words(texts)
    for lo in range(0, len(flat), WINDOW):
        yield _Window(off, flat, lo, min(lo + WINDOW, len(flat)), n)


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.diff(np.append(at, len(code)))


def _counted(w: _Window, n: int, parts: int) -> pa.RecordBatch:
    """One row for each part of the dictionary that the window has features of: zstd of their lines, sorted, and of their counts."""
    hashes = word_hashes(w.vocabulary)
    blobs: dict[int, tuple[list[memoryview], list[bytes]]] = {}
    for size in range(1, n + 1):
        code, count = _distinct(w.runs(size)[1])
        total = np.full(len(code), size, U)
        for x in w.words(code, size):
            total = mix(total ^ hashes[x])
        part = (total % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")  # runs stay sorted in their part, which packs them well
        part, count, lines = part[order], count[order].astype("<i4"), w.lines(code[order], size)
        if not len(part):
            continue
        off, data = np.frombuffer(lines.buffers()[1], np.int64), memoryview(lines.buffers()[2])
        cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            blob = blobs.setdefault(int(part[lo]), ([], []))
            blob[0].append(data[off[lo] : off[hi]])
            blob[1].append(count[lo:hi].tobytes())
    zip_ = zstandard.ZstdCompressor(level=6).compress
    packed = [[zip_(b"".join(x)) for x in blob] for blob in blobs.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int64()), *(pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1))], ["part", "features", "counts"])


def _merged(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(distinct features of a part as lines, their counts)."""
    unzip = zstandard.ZstdDecompressor().decompress
    counts = np.frombuffer(b"".join(unzip(x.as_py()) for x in t["counts"]), "<i4")
    data = bytearray()
    for x in t["features"]:
        data += unzip(x.as_py())
    ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A) + 1)
    coded = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    n = np.bincount(np.asarray(coded.indices), counts, len(coded.dictionary)).astype(np.int64)
    return coded.dictionary, n


def _hashed(features: pa.Array, buckets: int) -> np.ndarray:
    """Buckets of features, given as lines."""
    if not len(features):
        return np.zeros(0, np.int64)
    off = np.frombuffer(features.buffers()[1], np.int64)[features.offset : features.offset + len(features) + 1]
    data, crc = memoryview(features.buffers()[2]), zlib.crc32
    out = np.empty(len(features), np.int64)
    for lo in range(0, len(features), SPELLED):
        ends = (off[lo : lo + SPELLED + 1] - off[lo]).tolist()
        some = bytes(data[off[lo] : off[lo] + ends[-1]])
        out[lo : lo + SPELLED] = [crc(some[x : y - 1]) for x, y in zip(ends, ends[1:])]
    return out % buckets


def _parts(df: DataFrame, n: int, text_col: str) -> DataFrame:
    parts = max(1, -(-text_chars(df, text_col) // PART_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                for w in _windows(column(part, text_col), n):
                    yield _counted(w, n, parts)

    return df.select(text_col).mapInArrow(freeing(run), "part long, features binary, counts binary")


def feature_dictionary(df: DataFrame, n: int = 3, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """feature, n, bucket: each distinct feature of all texts, how often it occurs, and its bucket."""

    def run(t: pa.Table) -> pa.Table:
        features, count = _merged(t)
        return pa.table({"feature": pc.utf8_rtrim(features, "\n").cast(pa.string()), "n": count, "bucket": _hashed(features, buckets)})

    return _parts(df, n, text_col).groupBy("part").applyInArrow(freed(run), "feature string, n long, bucket long")


def bucket_counts(df: DataFrame, n: int = 3, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """bucket, n: the dictionary summed up by bucket, of which no more than `buckets` rows leave a part."""

    def run(t: pa.Table) -> pa.Table:
        features, count = _merged(t)
        total = np.bincount(_hashed(features, buckets), count, buckets).astype(np.int64)
        full = np.flatnonzero(total)
        return pa.table({"bucket": full, "n": total[full]})

    sums = _parts(df, n, text_col).groupBy("part").applyInArrow(freed(run), "bucket long, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain of bucket counts: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), of every bucket."""
    s, t = (cut_lineage(x.select("bucket", F.col("n").alias(name))) for x, name in ((corpus, "s"), (target, "t")))
    all_s, all_t = (x.agg(F.coalesce(F.sum(x.columns[1]), F.lit(0))).first()[0] for x in (s, t))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    ratio = n("t") * float(all_s + buckets) / (n("s") * float(all_t + buckets))
    every = s.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.floor(F.ln(ratio) * 1000.0).alias("gain"))


def weighed(df: DataFrame, gain: DataFrame, n: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight (the sum of the gains of all features) of each row."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"gains of over {MAX_BUCKETS} buckets are not sent to the executors")
    table = np.zeros(buckets, np.int64)
    for r in gain.collect():  # one row a bucket
        table[r.bucket] = r.gain
    sent = df.sparkSession.sparkContext.broadcast(table)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                texts, m = column(part, text_col), part.num_rows
                n_words, n_features, weight = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
                for w in _windows(texts, n):
                    n_words += np.bincount(w.text[: w.starts], minlength=m)
                    for text, crc in w.digests(n):
                        n_features += np.bincount(text, minlength=m)
                        weight += np.bincount(text, sent.value[crc % np.uint32(buckets)], m).astype(np.int64)
                yield pa.RecordBatch.from_arrays([column(part, id_col), pa.array(n_words), pa.array(n_features), pa.array(weight)], [id_col, "n_words", "n_features", "weight"])

    return df.select(id_col, text_col).mapInArrow(freeing(run), f"`{id_col}` {id_type}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), where u is told by the first 32 bits of the SHA-256 digest of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000.0)


def ranked(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """`rows` with `rank`: 1, 2, ... in the given order, null beyond `keep`. `order` must tell any two rows apart.

    The rows are range-sorted and written; a row's rank is its place in its partition and the rows of the partitions
    before, of which there is one number each.
    """
    rows = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_place", F.monotonically_increasing_id())
    placed = rows.withColumns({"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    sizes = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place") + 1
    return placed.join(sizes, "_part").withColumn("rank", F.when(rank <= keep, rank)).drop("_part", "_place", "_before")


def resampled(
    df: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """id, n_features, weight, score, rank of each row: rank counts the drawn ones, of highest score (ties: smaller id), else null.

    Of the rows with at least `min_words` words, `percent` in a hundred (rounded down) are drawn.
    """
    gain = gains(bucket_counts(df, n, buckets, text_col), bucket_counts(target, n, buckets, target_col), buckets)
    rows = weighed(df, gain, n, buckets, id_col, text_col)
    rows = cut_lineage(rows.withColumns({"score": F.col("weight") + gumbel(F.col(id_col), seed), "_row": F.monotonically_increasing_id()}))
    fit = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_row")]
    some = rows.where(fit)
    drawn = ranked(some, order, percent * some.count() // 100)
    return drawn.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))).select(id_col, "n_features", "weight", "score", "rank")
