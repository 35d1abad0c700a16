"""Byte-level BPE encoding and decoding by backtracking over longest matches, in time linear in the text.

A sequence of tokens is what the merges give exactly if each two neighbours, joined and merged by rank, give themselves
back. So a piece is encoded from left to right by the longest token that fits its left neighbour, stepping back to a
shorter one where no token fits; whether two tokens may be neighbours is worked out once and kept. The matches at all
places come from one pass of an automaton over the piece's bytes, mapped to Latin-1; of a long piece, window by window.

Texts are first cut by a pattern; each match is encoded by itself, and one that is a token as a whole is that token.

Nulls: a null text encodes as empty; null ids decode as empty. Empty texts have no tokens. Repeated rows are encoded
each; empty tables give empty results; columns other than the named ones are dropped by `encode`, kept by `decode`.
"""

from __future__ import annotations

import base64
import os
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terragrid.llm.shared import freeing, slices
from terragrid.llm.text import column, spread, units

#: Bytes of pieces and their ids that a worker keeps during a task, pairs whose compatibility it keeps, bytes of a window of a
#: piece's matches, and the largest rank file sent to executors.
KEPT_BYTES, PAIRS, WINDOW, MAX_VOCABULARY = 64 << 20, 1 << 17, 1 << 13, 64 << 20
#: Bytes of a dictionary's table for each entry, at its emptiest.
ENTRY_BYTES = 160
#: White space as Unicode defines it; what \s means in the patterns.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Encodes bytes by ranks; a token that the merges never build is used only for a piece that equals it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[int, tuple[int, int]] = {}  # what the last merge of a token joins; of a single byte, itself
        for t, i in ranks.items():
            parts, cut = self._merged(t)
            if len(parts) == 1:
                self.halves[i] = (ranks[t[:cut]], ranks[t[cut:]]) if cut else (i, i)
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.may_follow = lru_cache(maxsize=PAIRS)(self._may_follow)
        self.longest = max(map(len, ranks), default=0)
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def release(self) -> None:
        """Drops what was kept during a task."""
        self.pieces.clear()
        self.may_follow.cache_clear()
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, the leftmost of equals, until none can be merged."""
        return [self.ranks[p] for p in self._merged(piece)[0]]

    def _merged(self, piece: bytes) -> tuple[list[bytes], int]:
        """(what the merges leave, place of the last merge's cut)."""
        parts, cut = [piece[i : i + 1] for i in range(len(piece))], 0
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            cut = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, cut

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges of the two, joined, give the two back.

        The last of all their merges is undone, then the one before it, and so on: where the parts that meet at the border
        would have been merged before the merge just undone, they don't.
        """
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        limit = 1 << 40
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            below, above = halves[left][1], halves[right][0]
            if below != left and (left > right or above == right):
                limit, left = left, below
            elif above != right:  # of equals the leftmost goes first
                limit, right = right + 1, above
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        text = piece.decode("latin-1")
        found = self.matches(text) if n <= WINDOW else _Windows(self, text)  # tokens that start at a place, shortest first
        dead = bytearray(n + 1)  # places from which the rest can't be encoded
        out: list[int] = []
        untried: list[int] = []  # how many shorter tokens could still stand in the place of each
        at, may_follow = 0, self.may_follow
        options = found[0]
        left = len(options)
        while at < n:
            while left:
                left -= 1
                size, token = options[left]
                if not dead[at + size] and (not out or may_follow(out[-1], token)):
                    out.append(token)
                    untried.append(left)
                    at += size
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                at -= len(self.tokens[out.pop()])
                left, options = untried.pop(), found[at]
                continue
            if at < n:
                options = found[at]
                left = len(options)
        return out

    def matches(self, text: str) -> list[list[tuple[int, int]]]:
        """(size, token) of the tokens that start at each place, shortest first."""
        found: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            found[end - match[0] + 1].append(match)
        return found

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        known = self.pieces
        for piece in self.pattern.findall(text) if len(text) <= WINDOW else (m[0] for m in self.pattern.finditer(text)):
            ids = known.get(piece)
            if ids is None:
                found = self.piece(piece.encode())
                ids = struct.pack(f"<{len(found)}I", *found) if len(found) < WINDOW else np.asarray(found, "<u4").tobytes()
                size = sys.getsizeof(piece) + sys.getsizeof(ids) + ENTRY_BYTES
                if self.held + size <= KEPT_BYTES:  # while there is room: the commonest come first
                    known[piece] = ids
                    self.held += size
            out.append(ids)
        return b"".join(out)

    def unit(self, text: str) -> bytes:
        """Ids of a unit; most are one piece. White space alone may be cut otherwise than where it was a piece."""
        ids = self.pieces.get(text)
        return self.packed(text) if ids is None or text.isspace() else ids

    def text(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


class _Windows:
    """Matches of a long piece, of which the two last used windows are held."""

    def __init__(self, enc: Encoder, text: str) -> None:
        self.enc, self.text = enc, text
        self.held: dict[int, list[list[tuple[int, int]]]] = {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        i, place = divmod(at, WINDOW)
        if i not in self.held:
            if len(self.held) == 2:
                del self.held[next(iter(self.held))]
            self.held[i] = self.enc.matches(self.text[i * WINDOW : (i + 1) * WINDOW + self.enc.longest])[:WINDOW]
        return self.held[i][place]


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(read_ranks(data), pattern)


def encode_slice(texts: pa.Array, enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's ids, all ids); each distinct unit of the slice is encoded once."""
    off, flat = units(texts)
    if not len(flat):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    each = list(map(enc.unit, distinct))
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    code = np.asarray(coded.indices)
    ids = np.frombuffer(b"".join(each), "<u4")[spread(starts[code], size[code])]
    upto = np.concatenate([[0], np.cumsum(size[code])])
    return upto[off], ids


def _ranks(df: DataFrame, path: str):
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"a rank file of over {MAX_VOCABULARY} bytes is not sent to the executors")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _bytes_of(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, n_tokens long, ids binary (little-endian unsigned 32-bit ids of the whole text), and where `decoded` is set,
    decoded binary: the bytes that the ids stand for.

    Both in one function take one Python worker a task; `decode` over `encode` in one stage takes two at a time.
    """
    sent = _ranks(df, path)
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern)
        try:
            for batch in batches:
                for part in slices(batch, text_col):
                    off, ids = encode_slice(column(part, text_col), enc)
                    ends = pa.py_buffer((4 * off).astype("<i4"))  # a slice's ids take less than 2 GB, as its texts do
                    blobs = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, ends, pa.py_buffer(ids.astype("<u4"))])
                    back = [pa.array([_bytes_of(x, enc.tokens) for x in blobs.to_pylist()], pa.binary())] if decoded else []
                    yield pa.RecordBatch.from_arrays([column(part, id_col), pa.array(np.diff(off)), blobs, *back], names)
        finally:
            enc.release()

    return df.select(id_col, text_col).mapInArrow(freeing(run), f"`{id_col}` {id_type}, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with `ids_col` (as `encode` gives it) replaced by the bytes it stands for, in `out_col`."""
    sent = _ranks(df, path)
    kept = [f for f in df.schema.fields if f.name not in (ids_col, out_col)]
    schema = T.StructType([*kept, T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in read_ranks(sent.value).items()}
        for batch in batches:
            for part in slices(batch, ids_col):
                blobs = [_bytes_of(x or b"", tokens) for x in column(part, ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[column(part, f.name) for f in kept], pa.array(blobs, pa.binary())], schema.names)

    return df.mapInArrow(freeing(run), schema)
