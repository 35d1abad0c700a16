"""Vectorised words and hashes of Arrow string columns.

A word is a maximal run of code points other than space and U+0009 to U+000D. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def column(table: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A column as one contiguous array."""
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words): text i has words offsets[i]:offsets[i+1]."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = parts.flatten()
    filled = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(filled)])
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts)))])
    return before[bounds].astype(np.int64), flat.filter(pa.array(filled, pa.bool_()))


#: What a byte is in lowered words: A-Z lowered, other ASCII than letters and digits a space, the rest as it is.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[:0x80] = [ord(c.lower()) if (c := chr(i)).isalnum() else 0x20 for i in range(0x80)]


def lowered_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words), of words that are runs of letters, digits and non-ASCII, A-Z lowered."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if n == 0 or off[-1] == off[0]:
        return np.zeros(n + 1, np.int64), pa.array([], pa.large_string())
    data = _LOWERED[np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]]
    filled = data != 0x20
    starts = filled.copy()
    starts[1:] &= ~filled[:-1]
    bounds = off - off[0]
    heads = bounds[:-1][np.diff(bounds) > 0]
    starts[heads] |= filled[heads]  # a word ends with its text
    at = np.flatnonzero(starts)
    ends = np.append(np.cumsum(filled, dtype=np.int64)[at] - 1, np.count_nonzero(filled))
    flat = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[filled])])
    return np.searchsorted(at, bounds).astype(np.int64), flat


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the batch is hashed once."""
    coded = flat.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary))
    return known[np.asarray(coded.indices)] if len(flat) else np.zeros(0, U)


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of n words inside one text, with the position of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = total * _A + hashes[i : i + m]
        total = mix(total)
    inside = np.ones(m, bool)
    for cut in range(1, n):  # a run that starts fewer than n words before the end of its text crosses into the next
        at = offsets[1:] - cut
        inside[at[(at >= 0) & (at < m)]] = False
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths < n) & (lengths > 0))
    for i in short:
        inside[offsets[i] : min(offsets[i + 1], m)] = False
    at = np.flatnonzero(inside)
    return total[at], at


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges: starts[i], starts[i]+1, ... (lengths[i] of them)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


#: Bytes after a space at which a text may be cut before that space: no white space and no first byte of non-ASCII white space.
_CUT = np.ones(256, bool)
_CUT[:0x21] = False
_CUT[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def units(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's units, all units): the units of a text, joined, are the text.

    A unit starts at a space that is followed by something else than white space. Patterns that give such a space to the
    word after it, as byte-level BPE vocabularies use, match each unit as they match it inside the text.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    if n == 0 or off[-1] == off[0]:
        return np.zeros(n + 1, np.int64), pa.array([], pa.large_string())
    buf = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(buf[off[0] : off[-1] - 1] == 0x20) + off[0]
    at = at[_CUT[buf[at + 1]]]
    last = off[np.searchsorted(off, at, side="right")]  # end of the text that holds the space
    at = at[at + 1 < last]
    starts = np.sort(np.concatenate([off[:-1][np.diff(off) > 0], at]), kind="stable")  # two ascending runs
    starts = starts[np.append(True, starts[1:] != starts[:-1])]
    bounds = np.append(starts, off[-1]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), data])
    return np.searchsorted(starts, off).astype(np.int64), flat
