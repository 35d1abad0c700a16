"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines with a word. Each, with its number among equal ones, becomes a 64-bit digest of its
words. A sketch has three tables of s cells; a digest is added to one cell of each: cells hold a count, a sum of digests
and a sum of their 64-bit checks. Two sketches of a size subtract cell by cell; a cell left with a single digest, as its
check tells, gives it up, which empties further cells, until nothing is left: the digests in one version only are
recovered, at a cost in proportion to the difference. A sketch that does not empty, gives up a digest twice or more digests
than it has cells has failed: the pair is tried again with four times the cells and other hashes. One that has room for all
digests and yet fails MAX_TRIES times is a ValueError, never a guess.

How alike two texts are is told by a second level of the same sketches, over the pieces of the paragraphs that the first
level found to differ: a paragraph is cut at words chosen by their own hash (one in four on average), so that an edit
changes the cuts near it only. The likeness is the share of pieces that both texts have: 1 - |difference| / (|a| + |b|); 1
if both have none. Paragraphs in both have equal pieces, so it is the same as over all pieces.

Nulls count as empty texts; a null id comes before all others. Ties of ids are ordered by text. Texts with equal words
and lines have equal fingerprints. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrid.llm.shared import freeing, slices, text_chars
from terragrid.llm.text import U, column, mix, word_hashes, words

#: Cells in each of the three tables of the smallest sketch, which is the fingerprint; growth on failure; tries.
CELLS, GROWTH, MAX_TRIES = 4, 4, 40
#: A piece ends after a word whose hash is 0 modulo this.
CUT = 4
#: Characters of a range of documents, and the most ranges, of which the executors get one key each (48 bytes).
RANGE_CHARS, MAX_RANGES = 1 << 23, 1 << 20
_PLACE, _NUMBER, _PAIR = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0xD6E8FEB86659FD93)

Keyed = tuple[np.ndarray, np.ndarray]  # (text number, digest), ordered by text


def _sums(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A digest of each run of word hashes; the runs start at `starts` and fill h."""
    place = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(U)
    return mix(np.add.reduceat(mix(h + place * _PLACE), starts))


def _numbered(text: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Digests in which equal ones of a text differ by their number, in the order given."""
    order = np.lexsort((digest, text))
    t, d = text[order], digest[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(first)
    number = np.arange(len(d)) - np.repeat(at, np.diff(np.append(at, len(d))))
    out = np.empty(len(d), U)
    out[order] = mix(d + number.astype(U) * _NUMBER)
    return out


class Parts:
    """The paragraphs and pieces of a column of texts, numbered digests, ordered by text."""

    def __init__(self, texts: pa.Array) -> None:
        lines = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
        text_of_line = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lines)))
        off, flat = words(lines.flatten())
        h = word_hashes(flat)
        none = np.zeros(0, np.int64), np.zeros(0, U)
        self.n, self.paragraphs, self.paragraph_of_piece, self._pieces = len(texts), none, none[0], none
        if not len(h):
            return
        full = np.flatnonzero(np.diff(off) > 0)
        starts = off[:-1][full]
        text = text_of_line[full]
        self.paragraphs = text, _numbered(text, _sums(h, starts))
        last = mix(h) % U(CUT) == 0
        last[off[1:][full] - 1] = True
        cuts = np.append(0, np.flatnonzero(last)[:-1] + 1)
        self.paragraph_of_piece = np.searchsorted(starts, cuts, side="right") - 1
        self._pieces = text[self.paragraph_of_piece], _sums(h, cuts)

    def pieces(self, use: np.ndarray | slice = slice(None)) -> Keyed:
        """The pieces chosen, numbered among themselves."""
        text, digest = (x[use] for x in self._pieces)
        return text, _numbered(text, digest)

    def sizes(self, n: int) -> np.ndarray:
        return np.bincount(self._pieces[0], minlength=n)[:n]


def digests(texts: pa.Array) -> Keyed:
    """(text number, digest) of each text's pieces."""
    return Parts(texts).pieces()


def paragraph_digests(texts: pa.Array) -> Keyed:
    """(text number, digest) of each text's paragraphs."""
    return Parts(texts).paragraphs


def _check(key: np.ndarray) -> np.ndarray:
    return mix(key ^ _PAIR)


def _cells(key: np.ndarray, base: np.ndarray, s: np.ndarray, seed: int) -> list[np.ndarray]:
    """Positions of each key in its sketch's three tables."""
    return [base + i * s + (mix(key ^ mix(np.array([3 * seed + i + 1], U))) % s.astype(U)).astype(np.int64) for i in range(3)]


def _add(count: np.ndarray, total: np.ndarray, check: np.ndarray, cells: list[np.ndarray], sign: np.ndarray, key: np.ndarray) -> None:
    own = _check(key)
    signed, checked = np.where(sign > 0, key, U(0) - key), np.where(sign > 0, own, U(0) - own)
    for c in cells:
        np.add.at(count, c, sign)
        np.add.at(total, c, signed)
        np.add.at(check, c, checked)


def sketch_bytes(text: np.ndarray, key: np.ndarray, n: int) -> list[bytes]:
    """The smallest sketch of each of n texts: counts (32 bits), sums and sums of checks (64 bits) of 3 * CELLS cells."""
    s = np.full(len(key), CELLS)
    count, total, check = np.zeros(n * 3 * CELLS, np.int64), np.zeros(n * 3 * CELLS, U), np.zeros(n * 3 * CELLS, U)
    _add(count, total, check, _cells(key, text * 3 * CELLS, s, 0), np.ones(len(key), np.int64), key)
    rows = [x.astype(k).reshape(n, -1) for x, k in ((count, "<i4"), (total, "<u8"), (check, "<u8"))]
    return [b"".join(x.tobytes() for x in row) for row in zip(*rows)]


def _peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, owner: np.ndarray, base: np.ndarray, cells: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sketch, key, sign) given up by subtracted sketches that lie one after the other, and which sketches failed.

    A sound sketch empties a cell for good with each key, so it gives up each key once and no more keys than it has cells;
    one that goes beyond either is left at once, so the peeling ends.
    """
    n = len(cells)
    failed, spent = np.zeros(n, bool), np.zeros(n, np.int64)
    out = []
    look = np.arange(len(count))
    while len(look):
        look = look[(np.abs(count[look]) == 1) & ~failed[owner[look]]]
        sg = count[look]
        k = np.where(sg > 0, total[look], U(0) - total[look])
        pure = np.where(sg > 0, check[look], U(0) - check[look]) == _check(k)
        look, k, sg = look[pure], k[pure], sg[pure]
        p = owner[look]
        at = _cells(k, base[p], cells[p], seed)
        home = (at[0] == look) | (at[1] == look) | (at[2] == look)
        p, k, sg = p[home], k[home], sg[home]
        order = np.lexsort((k, p))
        p, k, sg = p[order], k[order], sg[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        p, k, sg = p[new], k[new], sg[new]
        spent += np.bincount(p, minlength=n)
        failed |= spent > 3 * cells
        at = _cells(k, base[p], cells[p], seed)
        _add(count, total, check, at, -sg, k)
        out.append((p, k, sg))
        look = np.unique(np.concatenate(at))
    p, k, sg = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
    failed[owner[(count != 0) | (total != 0) | (check != 0)]] = True
    order = np.lexsort((k, p))
    twice = (k[order][1:] == k[order][:-1]) & (p[order][1:] == p[order][:-1])
    failed[p[order][1:][twice]] = True
    return p, k, sg, failed


def reconcile(text_a: np.ndarray, key_a: np.ndarray, text_b: np.ndarray, key_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of the differences of n pairs of digest sets: sign 1 in a only, -1 in b only."""
    size_a, size_b = np.bincount(text_a, minlength=n), np.bincount(text_b, minlength=n)
    pair, key = np.concatenate([text_a, text_b]), np.concatenate([key_a, key_b])
    sign = np.concatenate([np.ones(len(key_a), np.int64), np.full(len(key_b), -1)])
    cells = np.full(n, CELLS)
    while (grow := 3 * cells < np.abs(size_a - size_b)).any():  # so many differences there are at least
        cells[grow] *= GROWTH
    todo, found = np.flatnonzero(size_a + size_b > 0), []
    for attempt in range(MAX_TRIES):
        if not len(todo):
            break
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        use = place[pair] >= 0
        p, s = place[pair[use]], cells[todo]
        base = np.concatenate([[0], np.cumsum(3 * s)[:-1]])
        width = int(3 * s.sum())
        sketch = np.zeros(width, np.int64), np.zeros(width, U), np.zeros(width, U)
        _add(*sketch, _cells(key[use], base[p], s[p], attempt), sign[use], key[use])
        p, k, sg, failed = _peel(*sketch, np.repeat(np.arange(len(todo)), 3 * s), base, s, attempt)
        good = ~failed[p]
        found.append((todo[p[good]], k[good], sg[good]))
        todo = todo[failed]
        cells[todo] = np.where(3 * cells[todo] < 4 * (size_a + size_b)[todo], cells[todo] * GROWTH, cells[todo] + CELLS)
    if len(todo):
        raise ValueError(f"{len(todo)} sketches can't be peeled")
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _differing(parts: Parts, text_from: int, pair: np.ndarray, key: np.ndarray, n: int) -> Keyed:
    """Pieces, by pair, of the paragraphs whose digests `key` differ in `pair`; pair i is text i + text_from."""
    text, digest = parts.paragraphs
    unlike = np.isin(mix(digest ^ mix((text - text_from).astype(U))), mix(key ^ mix(pair.astype(U))))
    unlike &= (text >= text_from) & (text < text_from + n)
    text, digest = parts.pieces(unlike[parts.paragraph_of_piece])
    return text - text_from, digest


def compare(a: Parts, b: Parts, n: int, from_b: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(likeness, differing paragraphs as `reconcile` gives them) of texts 0 to n - 1 of a with texts from_b on of b."""

    def cut(parts: Parts, low: int) -> Keyed:
        text, digest = parts.paragraphs
        use = (text >= low) & (text < low + n)
        return text[use] - low, digest[use]

    found = reconcile(*cut(a, 0), *cut(b, from_b), n)
    pair, key, sign = found
    unlike = [_differing(parts, low, pair[sign == s], key[sign == s], n) for parts, low, s in ((a, 0, 1), (b, from_b, -1))]
    pair, _, _ = reconcile(*unlike[0], *unlike[1], n)
    total = a.sizes(n) + np.bincount(b._pieces[0], minlength=from_b + n)[from_b : from_b + n]
    return np.where(total > 0, 1 - np.bincount(pair, minlength=n) / np.maximum(total, 1), 1.0), found


def differences(df: DataFrame, old_col: str, new_col: str, id_col: str = "doc_id") -> DataFrame:
    """id, removed array<long>, added array<long>, likeness: the paragraph digests that one version only has, ascending."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("removed", "added")], T.StructField("likeness", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, old_col):
                likeness, (pair, key, sign) = compare(Parts(column(part, old_col)), Parts(column(part, new_col)), part.num_rows)
                lists = []
                for s in (1, -1):
                    p, k = pair[sign == s], key[sign == s].view(np.int64)
                    order = np.lexsort((k, p))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(p, minlength=part.num_rows))])
                    lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(k[order])))
                yield pa.RecordBatch.from_arrays([column(part, id_col), *lists, pa.array(likeness)], schema.names)

    return df.select(id_col, old_col, new_col).mapInArrow(freeing(run), schema).withColumnRenamed("id", id_col)


def _with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """part, halo, id, text in ranges of (id, text), each range ordered and followed by the first row of the next (halo).

    The ranges' bounds come from a range shuffle of the keys alone (the id and the text's first characters), of which the
    driver gets the least key of each range; a row finds its range by binary search. The texts are shuffled once.
    """
    whole = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    # as bytes: ids in order (the sign bit turned), then the text's first code points
    key = F.concat(F.unhex(F.lpad(F.hex(whole.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 10).cast("binary"))
    ranges = min(MAX_RANGES, max(12, math.ceil(text_chars(df, text_col) / RANGE_CHARS)))
    keys = df.select(key.alias("key")).repartitionByRange(ranges, "key")
    least = keys.select(F.spark_partition_id().alias("part"), "key").groupBy("part").agg(F.min("key").alias("key"))
    bounds = np.sort(np.array([bytes(r.key) for r in least.select("key").collect()], "S48"))
    sent = df.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType())]))
    def place(keys: pa.Array) -> pa.Array:
        own, bounds = np.array(keys.to_pylist(), "S48"), sent.value
        part = np.searchsorted(bounds, own, "right") - 1
        return pa.StructArray.from_arrays([pa.array(part.astype(np.int32)), pa.array(bounds[part] == own if len(own) else np.zeros(0, bool))], ["part", "first"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), whole.alias("key"), place(key).alias("at"))
    here = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("halo"))
    before = F.struct(F.pmod(F.col("at.part") - 1, F.lit(max(len(bounds), 1))).cast("int").alias("part"), F.lit(True).alias("halo"))
    rows = rows.select("key", "id", "text", F.explode(F.when(F.col("at.first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
    rows = rows.select(F.col("to.part").alias("part"), F.col("to.halo").alias("halo"), "key", "id", "text")
    return rows.repartition(ranges, "part").sortWithinPartitions("part", "halo", "key", F.col("text").asc_nulls_first()).select("part", "halo", "id", "text")


def versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses, one row a document.

    The edited text has its last n_chars // 4 code points replaced by as many of the next document's first (or all), in
    the order of ids; the first document comes after the last. Columns: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def judged(t: pa.Table) -> pa.RecordBatch:
        """All rows but the last, which is only the next of the one before."""
        texts = [x or "" for x in t["text"].to_pylist()]
        n = len(texts) - 1
        edited = []
        for own, other in zip(texts, texts[1:]):
            cut = len(own) // 4
            edited.append(own[: len(own) - cut] + other[:cut])
        mine, changed = Parts(column(t, "text")), Parts(pa.array(edited, pa.large_string()))
        text, key = mine.paragraphs
        shown = [[base64.b64encode(b).decode() for b in sketch_bytes(*x, n)] for x in ((text[text < n], key[text < n]), changed.paragraphs)]
        near = compare(mine, changed, n)[0], compare(mine, mine, n, 1)[0]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        out = pa.RecordBatch.from_arrays([column(t, "id").slice(0, n), pa.array([len(x) for x in texts[:n]], pa.int64()), pa.array(sha), *map(pa.array, shown), *map(pa.array, near)], schema.names)
        return out.filter(pc.invert(column(t, "halo").slice(0, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            for part in slices(batch, "text"):
                t = pa.Table.from_batches([part])
                t = t if rest is None else pa.concat_tables([rest, t])
                rest = t.slice(t.num_rows - 1)
                if t.num_rows > 1:
                    yield judged(t)

    return _with_next(df, id_col, text_col).drop("part").mapInArrow(freeing(run), schema).withColumnRenamed("id", id_col)
