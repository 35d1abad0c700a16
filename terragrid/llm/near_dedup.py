"""Near-duplicates by DartMinHash: sparse weighted signatures, a banded join, and exact verification.

An element (a hashed shingle) with weight w owns the region [0, w) of a weight axis. Darts fall on it at the times of a
Poisson process seeded by the element alone, so equal elements of two texts get equal darts. A text throws darts at its
regions until about k ln k + 2k have landed in all, and each of k coordinates keeps its earliest dart: two signatures
agree in a coordinate with the probability of the texts' weighted Jaccard similarity. The time per text is in proportion
to its shingles plus k log k, whatever the weights.

A shingle weighs as often as its text has it, and two texts are alike by the weighted Jaccard similarity: the sum of the
lesser weights over the sum of the greater ones (`weighted` false: all weigh 1, as sets). Signatures, verification and
classes of equal texts go by the same weights.

Bands of `rows` coordinates are joined. No bucket's pairs are written out: each member is first held against the
smallest one of a bucket or two, by the exact similarity of the shingles. Members that are connected then need no more
comparisons. Where a bucket still falls into several components, its members are compared in blocks of bounded size: first
by signatures alone, which tells the members that have a likely partner in the block, then only these by their shingles, in
place. Each member meets its own block first. What then is not in a bucket's largest component meets all its blocks; the
largest component's blocks don't meet each other. Only links leave a block, fewer than it has members. A link within the threshold is missed only if the pair shares no
band (3e-6 at a similarity of exactly 0.8 with 24 bands of 4) or its signature is over 6 standard deviations off (1e-9).

Nulls: null texts and texts without words have no shingles and are linked to nothing; a null id is left alone. A text of
fewer words than a shingle has one shingle, all its words. Rows that repeat an id with another text are documents of their
own; rows that repeat id and text are one. Where texts of one id lead a class, the row of one of them is kept. Empty tables
give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terragrid.llm.components import components
from terragrid.llm.shared import cut_lineage, freeing, slices
from terragrid.llm.text import U, column, grams, mix, word_hashes, words

#: Members of a bucket that are compared with one another at a time, and shingles that they have together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Tasks that the members of one class are dealt to when they are given its id.
SALTS = 8
#: Leaders (smallest members of its buckets) that a text is held against before blocks are compared.
LEADERS = 2


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of n words, ordered by text."""
    off, flat = words(texts)
    hashes = word_hashes(flat)
    g, at = grams(hashes, off, n)
    text = np.searchsorted(off, at, side="right") - 1
    size = np.diff(off)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = [sum(int(h) * (2 * i + 3) for i, h in enumerate(hashes[off[t] : off[t + 1]])) % 2**64 ^ int(size[t]) for t in short]
        g, text = np.concatenate([g, mix(np.array(whole, U))]), np.concatenate([text, short])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], g[at], np.diff(np.append(at, len(g)))


def signatures(text: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_texts: int, k: int, seed: int = 0) -> np.ndarray:
    """(n_texts, k) dart ids; texts without elements have zeros. `text` is ascending, weights are positive."""
    out = np.zeros((n_texts, k), U)
    total = np.bincount(text, weights, n_texts)
    many = k * math.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    salt = mix(np.array([seed + 1], U))[0]
    while len(todo):
        until = np.zeros(n_texts)
        until[todo] = many / total[todo]
        use = np.flatnonzero(until[text] > 0)
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, width = 0.0, 1.0
        while len(use):  # regions [0,1), [1,2), [2,4), [4,8), ... of the weight axis
            x, w, t = elements[use], weights[use], text[use]
            state = mix(x ^ mix(np.array([int(low)], U))[0] ^ salt)
            time, limit = np.zeros(len(use)), until[t]
            while len(state):
                state = mix(state + U(0x9E3779B97F4A7C15))
                time = time - np.log(((state >> U(11)) + U(1)).astype(np.float64) * 2.0**-53) / width
                live = time <= limit
                state, time, limit, t, w = state[live], time[live], limit[live], t[live], w[live]
                dart = mix(state ^ U(0xD1B54A32D192ED03))
                height = low + width * ((mix(dart) >> U(11)).astype(np.float64) * 2.0**-53)
                hit = height < w
                darts.append((t[hit], time[hit], dart[hit]))
            low, width = (1.0, 1.0) if low == 0 else (low * 2, width * 2)
            use = use[weights[use] > low]
        t, time, dart = (np.concatenate(c) for c in zip(*darts))
        slot = t * k + (dart % U(k)).astype(np.int64)
        rank = np.minimum(time / until[t] * 2.0**30, 2.0**30 - 1).astype(np.int64)
        order = np.argsort(slot.astype(np.int64) << 30 | rank, kind="stable") if n_texts * k < 1 << 33 else np.lexsort((time, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = dart[first]
        got = np.bincount(slot[first] // k, minlength=n_texts)
        todo = todo[got[todo] < k]  # a coordinate without a dart: throw twice as many
        many *= 2
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts, k / rows) hashes of `rows` coordinates each."""
    n, k = sig.shape
    out = np.zeros((n, k // rows), U)
    for i in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + sig[:, i::rows][:, : k // rows])
    return mix(out + np.arange(k // rows).astype(U))


def fingerprints(df: DataFrame, n: int = 5, bands: int = 24, rows: int = 4, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tkey (the text's xxhash64), n_shingles (the sum of weights), set_a and set_b (a 128-bit hash of the weighted set), bands array<long>, sig binary (16 bits a coordinate:
    chance agreements add candidates, they take none away)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                m = part.num_rows
                text, x, count = shingles(column(part, text_col), n)
                sig = signatures(text, x, count.astype(np.float64) if weighted else np.ones(len(x)), m, bands * rows)
                size = np.bincount(text, count if weighted else None, minlength=m).astype(np.int64)
                sums = [np.zeros(m, U), np.zeros(m, U)]
                for s, salt in zip(sums, (0x632BE59BD9B4E019, 0x9FB21C651E98DF25)):
                    np.add.at(s, text, mix(x ^ U(salt)) if not weighted else mix(x ^ U(salt)) * count.astype(U))
                keys = band_keys(sig, rows).view(np.int64)
                full = size > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)), pa.array(keys[full].reshape(-1)))
                blobs = [s.tobytes() if f else b"" for s, f in zip((sig & U(0xFFFF)).astype("<u2"), full)]
                cols = [column(part, id_col), column(part, "tkey"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists, pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "tkey", "n_shingles", "set_a", "set_b", "bands", "sig"])

    keyed = df.select(id_col, text_col, F.xxhash64(text_col).alias("tkey"))
    return keyed.mapInArrow(freeing(run), f"id {id_type}, tkey long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary")


def shingle_sets(df: DataFrame, n: int, weighted: bool, id_col: str, text_col: str) -> DataFrame:
    """id, shingles array<long> (distinct, ascending as unsigned numbers), weights array<int>."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                text, x, count = shingles(column(part, text_col), n)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=part.num_rows))]).astype(np.int32))
                weights = count if weighted else np.ones(len(count))
                yield pa.RecordBatch.from_arrays([column(part, id_col), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x.view(np.int64), weights.astype(np.int32)))], ["id", "shingles", "weights"])

    return df.select(id_col, text_col).mapInArrow(freeing(run), f"id {id_type}, shingles array<long>, weights array<int>")


def alike(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, threshold: float) -> bool:
    """Whether two weighted sets of distinct shingles have a similarity of `threshold` or more."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(wx[i], wy[j]).sum())
    return shared >= threshold * (int(wx.sum()) + int(wy.sum()) - shared) - 1e-9


def similar_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted sets (id, shingles, weights) have a similarity of `threshold` or more."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"), F.col("weights").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_Lists(column(batch, c)) for c in ("sa", "wa", "sb", "wb")]
            good = [alike(*(v[i] for v in held), threshold) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    kinds = [f"{c} {both.schema[c].dataType.simpleString()}" for c in ("a", "b")]
    return both.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(freeing(run), ", ".join(kinds))


class _Lists:
    """Rows of a list column as arrays, without a copy."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.ends, self.flat = lists.offsets.to_numpy(), lists.values.to_numpy()

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, over the ends of batches; one group at a time is held besides a batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = np.stack([t[c].to_numpy() for c in keys])
        cuts = [0, *np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1])  # the last group may go on in the next batch
    if rest is not None:
        yield rest


PLACE = ["bucket", "i", "j"]


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks of a group; of one block twice where it meets itself."""
    own = t["own"].to_numpy()
    return np.flatnonzero(own == t["i"][0].as_py()), np.flatnonzero(own == t["j"][0].as_py())


def _signatures_of(t: pa.Table, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, k)


def _likely(least: float, k: int):
    """mapInArrow over rows ordered by (bucket, i, j): those with a partner of another component and a likely signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, PLACE):
            label, (left, right) = t["label"].to_numpy(), _sides(t)
            if (label == label[0]).all():
                continue
            sig, likely = _signatures_of(t, k), np.zeros(t.num_rows, bool)
            for x in left:
                y = right[label[right] != label[x]]
                y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
                likely[y] = True
                likely[x] |= len(y) > 0
            if likely.any():
                yield from t.drop_columns(["sig"]).filter(pa.array(likely)).combine_chunks().to_batches()

    return run


def _compare_blocks(least: float, threshold: float, k: int):
    """mapInArrow over rows ordered by (bucket, i, j): links between members of one group that differ in component.

    Likely pairs are verified by their shingle sets here, the most alike first; what a link connects needs no other, so a
    group gives fewer links than it has members.
    """

    def pairs(t: pa.Table) -> tuple[list[int], list[int]]:
        sig, (left, right) = _signatures_of(t, k), _sides(t)
        ids, label = t["id"].to_numpy(), t["label"].to_numpy().copy()
        shingles_, weights = _Lists(column(t, "shingles")), _Lists(column(t, "weights"))
        one = t["i"][0].as_py() == t["j"][0].as_py()
        found = [], []
        for x in left:
            y = right[(label[right] != label[x]) & (ids[right] > ids[x] if one else True)]
            if not len(y):
                continue
            agree = (sig[y] == sig[x]).mean(axis=1)
            for z in y[np.argsort(-agree, kind="stable")][: int((agree >= least).sum())]:
                if label[z] == label[x]:
                    continue
                if alike(shingles_[x], weights[x], shingles_[z], weights[z], threshold):
                    found[0].append(min(ids[x], ids[z]))
                    found[1].append(max(ids[x], ids[z]))
                    label[label == label[z]] = label[x]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, PLACE):
            if t.num_rows > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs(t)], ["a", "b"])

    return run


def _blocks(members: Column, n_shingles: Column) -> Column:
    """Blocks that so many members with so many shingles are dealt to."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(n_shingles / BLOCK_SHINGLES)).cast("int")


def within_blocks(placed: DataFrame) -> DataFrame:
    """bucket, i, j, own, rep, label: each member of a bucket of several components once, in its block, which meets itself."""
    open_ = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return placed.join(open_, "bucket").select("bucket", own.alias("i"), own.alias("j"), own.alias("own"), "rep", "label")


def across_blocks(placed: DataFrame) -> DataFrame:
    """The same columns for buckets of several blocks: all members of different components meet.

    The bucket's largest component is dealt to blocks of its own, and so are the others' members, the stragglers. Each
    block of stragglers meets all blocks; the largest component's blocks don't meet each other, as its members need no link.
    """
    parts = placed.where("blocks > 1").groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = parts.groupBy("bucket").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    sizes = sizes.select("bucket", F.col("top.label").alias("main"), _blocks(F.col("top.n"), F.col("top.w")).alias("mains"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("others"))
    held, hashed = placed.join(sizes, "bucket"), F.xxhash64("rep")
    strays = F.col("label") != F.col("main")
    own = F.when(strays, F.col("mains") + F.pmod(hashed, F.col("others"))).otherwise(F.pmod(hashed, F.col("mains"))).cast("int")
    other = F.explode(F.sequence(F.when(strays, 0).otherwise(F.col("mains")), F.col("mains") + F.col("others") - 1))
    met = held.withColumn("own", own).withColumn("other", other)
    return met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label")


def near_duplicates(df: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class_id, keep: class_id is the smallest id of the texts that links of `threshold` or more connect.

    Ids are integers. `keep` marks the one document of each class that has the class's id.
    """
    return _classified(df, n, threshold, bands, rows, weighted, id_col, text_col).drop("tkey")


def _classified(df: DataFrame, n: int, threshold: float, bands: int, rows: int, weighted: bool, id_col: str, text_col: str) -> DataFrame:
    prints = cut_lineage(fingerprints(df, n, bands, rows, weighted, id_col, text_col))
    named = ["set_a", "set_b", "n_shingles"]
    sets = prints.where("n_shingles > 0 AND id IS NOT NULL").groupBy(*named).agg(F.min(F.struct("id", "tkey")).alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sets = cut_lineage(sets.withColumn("rep", F.monotonically_increasing_id()))  # an id may hold several sets, so they have numbers of their own
    members = sets.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("size"), _blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("size > 1")
    members = cut_lineage(members.join(buckets, "bucket"))
    compared = sets.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("first.id").alias("f_id"), F.col("first.tkey").alias("f_key"))
    rows_ = df.select(F.col(id_col).alias("r_id"), F.xxhash64(text_col).alias("r_key"), F.col(text_col).alias("text"))
    firsts = rows_.join(compared, (F.col("r_id") == F.col("f_id")) & (F.col("r_key") == F.col("f_key"))).select("rep", "text")
    texts = cut_lineage(shingle_sets(firsts, n, weighted, "rep", "text"))
    star = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = labels = tried = None
    for _ in range(LEADERS):  # one leader each time; those already connected need no other
        new = star
        if labels is not None:
            la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
            new = star.join(tried, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(apart).select("a", "b")
        new = cut_lineage(new.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        found = similar_pairs(new, texts, threshold)
        links = cut_lineage(found if links is None else links.unionByName(found))
        tried = new if tried is None else tried.unionByName(new)
        labels = components(links)
    # buckets that still fall into several components
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    prints_ = sets.select("rep", "sig")
    for deal in (within_blocks, across_blocks):
        placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "n_shingles", "blocks", F.coalesce("label", "rep").alias("label"))
        place = [*PLACE, "own", "rep", F.col("rep").cast("long").alias("id"), F.col("label").cast("long").alias("label")]
        dealt = deal(placed).join(prints_, "rep").select(*place, "sig").repartition(*PLACE).sortWithinPartitions(*PLACE)
        likely = cut_lineage(dealt.mapInArrow(freeing(_likely(least, bands * rows)), "bucket long, i int, j int, own int, rep long, id long, label long"))
        dealt = likely.join(prints_, "rep").join(texts.withColumnRenamed("id", "rep"), "rep").drop("rep").repartition(*PLACE).sortWithinPartitions(*PLACE)
        more = cut_lineage(dealt.mapInArrow(freeing(_compare_blocks(least, threshold, bands * rows)), "a long, b long").distinct())
        if not more.isEmpty():
            links = cut_lineage(links.unionByName(more))
            labels = components(links)
    labelled = sets.select(*named, "rep", F.col("first.id").alias("first")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    leads = labelled.groupBy("label").agg(F.min(F.struct("first", "rep")).alias("lead")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = labelled.withColumn("salt", F.pmod("rep", F.lit(SALTS)).cast("int")).join(leads, ["label", "salt"])
    classes = classes.select(*named, F.col("lead.first").alias("class_id"), (F.col("rep") == F.col("lead.rep")).alias("leads"))
    out = prints.select("id", "tkey", *named).join(classes, named, "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    keep = F.coalesce((class_id == F.col("id")) & F.coalesce("leads", F.lit(True)), F.lit(True))
    return out.select(F.col("id").alias(id_col), "tkey", "n_shingles", class_id.alias("class_id"), keep.alias("keep"))


def deduplicated(df: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, weighted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` without near-duplicates: of each class the document with the smallest id stays.

    Rows are told by id and text: where an id has several texts, each stays or goes with its own class. Rows that repeat a
    kept row's id and text stay with it.
    """
    out = _classified(df, n, threshold, bands, rows, weighted, id_col, text_col)
    gone = out.where("NOT keep").select(F.col(id_col).alias("_gone_id"), F.col("tkey").alias("_gone_key")).distinct()
    same = (F.col(id_col) == F.col("_gone_id")) & (F.xxhash64(text_col) == F.col("_gone_key"))
    return df.join(gone, same, "left_anti")
