"""Token counts by the installed tokenizer libraries, in Arrow functions that return lengths only.

Rows are worked off in slices of bounded bytes, and the library gets batches of bounded bytes (UTF-8); a longer text is one
of its own. For byte-level BPE
vocabularies long texts are cut at safe boundaries (a space before a word), and each distinct piece of a slice is encoded
once; pieces already counted are kept up to a bound. Other vocabularies get whole texts.

Nulls: a null text counts as empty, with 0 tokens; a null id passes through. Repeated rows are counted each. Empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from terragrid.llm.shared import freeing, slices
from terragrid.llm.text import column, units

#: Bytes of one batch that a library gets, bytes of pieces and counts that a worker keeps, and of a dictionary's entry beside its piece.
BATCH_BYTES, KEPT_BYTES, ENTRY_BYTES = 1 << 20, 32 << 20, 192
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 64 << 20


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizers file is plain byte-level BPE, so that a space before a word always starts a new piece."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    return plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in spec.get("added_tokens", []))


@lru_cache(maxsize=4)
def _counter(kind: str, data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(token counts of texts, whether texts may be cut at spaces)."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core already
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode())
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)], cuts_at_spaces(json.loads(data))
    if kind == "model":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)], False
    raise ValueError(f"a vocabulary is a .json or a .model file, not .{kind}")


def _by_bytes(texts: list[str]) -> Iterator[list[str]]:
    batch, held = [], 0
    for t in texts:
        size = len(t) if t.isascii() else len(t.encode())
        if batch and held + size > BATCH_BYTES:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += size
    if batch:
        yield batch


class _Known:
    """Counts of pieces, kept while there is room: the commonest come first."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.held = 0

    def of(self, pieces: list[str], count: Callable[[list[str]], list[int]]) -> np.ndarray:
        out = np.fromiter((self.counts.get(x, -1) for x in pieces), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        done = 0
        for batch in _by_bytes([pieces[i] for i in new]):
            found = count(batch)
            out[new[done : done + len(batch)]] = found
            done += len(batch)
            for x, n in zip(batch, found):
                size = sys.getsizeof(x) + ENTRY_BYTES
                if self.held + size <= KEPT_BYTES:
                    self.counts[x] = n
                    self.held += size
        return out


def _count(texts: pa.Array, count: Callable[[list[str]], list[int]], cut: bool, known: _Known) -> np.ndarray:
    if not cut:
        plain = texts.fill_null("").to_pylist()
        return np.fromiter((n for b in _by_bytes(plain) for n in count(b)), np.int64, len(plain))
    off, flat = units(texts)
    coded = flat.dictionary_encode()
    each = known.of(coded.dictionary.to_pylist(), count)
    upto = np.concatenate([[0], np.cumsum(each[np.asarray(coded.indices)])]) if len(flat) else np.zeros(1, np.int64)
    return upto[off[1:]] - upto[off[:-1]]


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row, by the vocabulary file at `path`.

    Special tokens are not added; their strings in a text are handled as the library does by default.
    """
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary file of over {MAX_VOCABULARY} bytes is not sent to the executors")
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    kind = path.rsplit(".", 1)[-1]
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = _counter(kind, sent.value)
        known = _Known()
        for batch in batches:
            for part in slices(batch, text_col):
                texts = column(part, text_col)
                n = _count(texts, count, cut, known)
                size = pc.binary_length(texts.fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([column(part, id_col), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(freeing(run), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
