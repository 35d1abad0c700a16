"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, one scan of each text.

A window is `n` consecutive words of an item (its question, answer, or both as given); an item of fewer words, but not
none, is one window. Texts and items are normalised alike: A-Z lowered, words (runs of letters, digits and non-ASCII)
joined by one space, with a space before the first and after the last, so that a match begins and ends with words. All
occurrences of all windows come from one pass over the normalised text; the words they cover are told by their number,
and, for texts that have any, by their offsets in the original.

The automaton is sent to the executors; its size is checked first. A benchmark beyond MAX_CHARS of windows is dealt to as
many automata by a hash of the window, and the texts are scanned by one after the other, with the hits written in between.

Nulls: a null text has no words and no hits; a null document id passes through; items are told by id, so rows that repeat
an id are one item, and a null item id is the empty string. Repeated documents are judged each. An empty benchmark hits
nothing; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrid.llm.shared import cut_lineage, freeing, slices
from terragrid.llm.text import column, lowered_words

#: Characters of windows that one automaton holds; an automaton takes some 50 bytes for each.
MAX_CHARS = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ORIGINAL = regex.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (normalised), n_words, items array<string> (ids, ascending): each distinct window of all items."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(WORD), F.lit(0))
    some = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    cut = some.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("w"))
    return cut.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n_words")).agg(F.array_sort(F.collect_set("item")).alias("items"))


@lru_cache(maxsize=1)
def _automaton(data: bytes) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for window, n_words, items in pickle.loads(data):
        a.add_word(f" {window} ", (n_words, items))
    if len(a):
        a.make_automaton()
    return a


class Hits:
    """What an automaton finds in one normalised text: items, and merged spans of words, ends exclusive."""

    def __init__(self, found: list[tuple[int, tuple[int, tuple[str, ...]]]], text: str) -> None:
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
        ends = np.searchsorted(spaces, [end for end, _ in found])  # the k-th space ends word k - 1
        self.items = {i for _, (_, items) in found for i in items}
        self.spans = merged([(int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, found)])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that meet or overlap are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_LONGS = ("word", "n_words", "start", "end")
_ADDED = {
    "n_words": T.LongType(),
    "items": T.ArrayType(T.StringType()),
    "spans": T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _LONGS])),
}
_ARROW = {"n_words": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([(c, pa.int64()) for c in _LONGS]))}


def _original(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with the code points of the original that they take, ends exclusive."""
    edges = {x for lo, hi in spans for x in (lo, hi - 1)}
    at = {i: m.span() for i, m in enumerate(_ORIGINAL.finditer(text)) if i in edges}
    return [{"word": lo, "n_words": hi - lo, "start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in spans]


def _scan(df: DataFrame, found: list, text_col: str) -> DataFrame:
    """`df` with n_words, items and spans, joined to those that it has already."""
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps([(r.window, r.n_words, tuple(r.items)) for r in found]))
    kept = [f for f in df.schema.fields if f.name not in _ADDED]
    again = "spans" in df.columns
    schema = T.StructType([*kept, *(T.StructField(c, k) for c, k in _ADDED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = column(part, text_col)
                off, flat = lowered_words(texts)
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off), flat), pa.scalar(" ", pa.large_string()))
                items, spans = [[] for _ in texts], [[] for _ in texts]
                if again:
                    items, spans = column(part, "items").to_pylist(), column(part, "spans").to_pylist()
                for i, text in enumerate(joined.to_pylist() if len(automaton) else ()):
                    text = f" {text} "
                    if got := list(automaton.iter(text)):
                        hits = Hits(got, text)
                        items[i] = sorted({*items[i], *hits.items})
                        before = [(s["word"], s["word"] + s["n_words"]) for s in spans[i]]
                        spans[i] = _original(texts[i].as_py(), merged([*before, *hits.spans]))
                new = [pa.array(x, _ARROW[c]) for c, x in zip(_ADDED, (np.diff(off), items, spans))]
                yield pa.RecordBatch.from_arrays([*[column(part, f.name) for f in kept], *new], schema.names)

    return df.mapInArrow(freeing(run), schema)


def contamination(df: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """`df` with n_words, items array<string> (ids of items with occurring windows, ascending) and spans.

    Spans are array<struct<word, n_words, start, end>>: maximal runs of hit words, by number and by code points of the
    original text. Columns of `df` of these three names are replaced.
    """
    df = df.drop(*_ADDED)
    listed = cut_lineage(windows(benchmark, n, item_id, item_text))
    chars = listed.agg(F.sum(F.length("window") + F.length(F.array_join("items", ",")))).first()[0] or 0
    packs = max(1, -(-chars // max_chars))
    for i in range(packs):
        own = listed.where(F.pmod(F.xxhash64("window"), F.lit(packs)) == i) if packs > 1 else listed
        df = _scan(df, own.collect(), text_col)  # about max_chars of windows
        if packs > 1:
            df = cut_lineage(df)
    return df


def n_hit(spans: Column) -> Column:
    """Words that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, s: total + s["n_words"])


def decontaminated(df: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `df` without any occurrence of a benchmark window."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("_text"))
    return contamination(row, benchmark, n, "_text", item_id, item_text).where(F.size("spans") == 0).select("row.*")
