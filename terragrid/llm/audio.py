"""Chroma audio fingerprints of a binary media column, and a search that aligns recordings.

Samples are cut into overlapping frames; each frame's spectrum is folded into 12 pitch classes. Over the frames' integral
image, 16 filters compare the energy of rectangles of a window of 16 frames; each comparison gives 2 bits (Gray code), so
that each frame becomes a packed 32-bit integer, of which similar sounds differ in few bits.

The search finds, for every recording whose id is divisible by `every`, all recordings that align with it. Recordings
with equal fingerprints are one class and are compared once. An alignment with a bit error rate of e at most has an integer
with 32 e unequal bits at most (no mean is under its least term), so the queries' integers are looked up with up to so many
bits turned; every second one with a bit less, where the bits that this leaves unseen still exceed an admitted rate. Among
many integers a lookup tries all turned bits of a key of up to 24 bits, among a few it tries each half with half of the bits.
Every pair of integers found is a vote for its offset in the histogram of its two recordings. As each overlapping integer
without a vote costs the bits it is apart at least, an offset's votes, weighed by their unequal bits, bound its bit errors
from below: offsets with less weight than an admitted rate leaves room for are turned down unread, all others are judged by
the integers that overlap there, and the one with the lowest bit error rate stays. No admitted pair is missed, whatever its
length or offset.

Queries and classes are dealt into packs of bounded size, and each pack of queries meets each pack of classes in one task:
the work grows with queries times recordings, by a small factor (about 5 of 100,000 pairs of integers are votes).

Nulls: null or empty media have no integers and belong to no class; null ids are in no class. Recordings shorter than a
window are repeated up to it. Repeated rows are members of one class. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terragrid.llm.shared import cut_lineage, freeing, slices
from terragrid.llm.text import U, column, mix, spread

#: Frames of a filter's window.
WINDOW = 16
#: Integers of a pack of queries and of a pack of classes; a longer recording is in a pack of its own or ends one.
QUERY_PACK, CLASS_PACK = 1 << 18, 1 << 20
#: Candidates, proposals or integers worked on at once, and offsets of all histograms that a task holds.
STEP, OFFSETS = 1 << 20, 1 << 20
#: Integers of queries whose histograms are filled together, so that they are whole before they are judged.
TOGETHER = 1 << 12
#: Keys looked up at once, and bits of a key at most.
PROBES, KEY_BITS = 1 << 17, 24
#: Frames of a batch of transforms, and levels of a pitch class's share.
BATCH, LEVELS = 1 << 15, 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, pitch classes, frames) of the 16 filters, by rule: kinds in turn, sizes growing."""
    out = []
    for i in range(16):
        high = (2, 4, 6, 8, 12)[i % 5]
        out.append((i % 4, (5 * i) % (12 - high + 1), high, (4, 8, 12, 16)[i // 4]))
    return out


def samples(media: bytes, kind: str = "wav", rate: int | None = None) -> np.ndarray:
    """Mono samples in -1 to 1: of PCM WAV files (8 or 16 bits), or of bare unsigned 8-bit PCM (`u8`).

    A WAV file of another rate than `rate` is brought to it: each new sample is the mean of the old ones over its time.
    """
    if kind == "u8":
        return (np.frombuffer(media, np.uint8).astype(np.float32) - 128) / 128
    with wave.open(io.BytesIO(media)) as w:
        raw, wide, n, own = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if wide not in (1, 2):
        raise ValueError("8 or 16 bits a sample are read")
    x = np.frombuffer(raw, np.uint8 if wide == 1 else "<i2").astype(np.float32)
    x = ((x - 128) / 128 if wide == 1 else x / 32768).reshape(-1, n).mean(axis=1)
    if rate is None or own == rate:
        return x
    upto = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    ends = np.arange(len(x) * rate // own + 1) * (own / rate)
    return (np.diff(np.interp(ends, np.arange(len(upto)), upto)) * (rate / own)).astype(np.float32)


def pitch_classes(rate: int, frame: int) -> np.ndarray:
    """(frame / 2 + 1, 12) weights that fold a spectrum's bins from 50 Hz up into pitch classes."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    fold = np.zeros((len(hz), 12), np.float32)
    use = hz >= max(50, rate / frame)
    fold[np.flatnonzero(use), np.rint(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return fold


def fingerprints_of(recordings: list[np.ndarray], rate: int, frame: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, integers): the packed integers of each recording; none for an empty one."""
    least = frame + (WINDOW - 1) * hop
    whole = [np.resize(x, least) if 0 < len(x) < least else x for x in recordings]
    size = np.array([len(x) for x in whole], np.int64)
    count = np.where(size > 0, 1 + (size - frame) // hop, 0)
    ends = np.concatenate([[0], np.cumsum(np.maximum(count - WINDOW + 1, 0))])
    if not count.sum():
        return ends, np.zeros(0, np.uint32)
    buf = np.concatenate(whole).astype(np.float32)
    starts = spread(np.zeros(len(count), np.int64), count) * hop + np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), count)
    fold, shape = pitch_classes(rate, frame), np.hanning(frame).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(buf, frame)
    chroma = np.empty((len(starts), 12), np.float32)
    for i in range(0, len(starts), BATCH):
        spectrum = np.fft.rfft(frames[starts[i : i + BATCH]] * shape, axis=1)
        chroma[i : i + BATCH] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ fold
    chroma = np.sqrt(chroma)
    chroma /= chroma.sum(axis=1, keepdims=True) + 1e-6
    image = np.zeros((len(starts) + 1, 13), np.int64)  # whole numbers: sums don't depend on what else is in the batch
    image[1:, 1:] = np.rint(chroma * LEVELS).astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    at = spread(np.concatenate([[0], np.cumsum(count)[:-1]]), np.maximum(count - WINDOW + 1, 0))

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(len(at), np.uint32)
    for kind, low, high, wide in filters():
        mid, half = low + high // 2, wide // 2
        if kind == 0:  # later against earlier
            a, b = box(half, wide, low, low + high), box(0, half, low, low + high)
        elif kind == 1:  # higher against lower
            a, b = box(0, wide, mid, low + high), box(0, wide, low, mid)
        elif kind == 2:  # the two diagonals
            a = box(0, half, low, mid) + box(half, wide, mid, low + high)
            b = box(half, wide, low, mid) + box(0, half, mid, low + high)
        else:  # the middle against the sides
            q = wide // 4
            a, b = box(q, wide - q, low, low + high), box(0, q, low, low + high) + box(wide - q, wide, low, low + high)
        value = np.log((a + 0.05 * LEVELS) / (b + 0.05 * LEVELS))
        level = np.digitize(value, (-0.05, 0.0, 0.05))
        out = out << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)
    return ends, out


def fingerprints(df: DataFrame, media_col: str, kind: str = "wav", rate: int = 11025, frame: int = 4096, hop: int = 1365, id_col: str = "id") -> DataFrame:
    """id, n_ints int, fp_a and fp_b (a 128-bit hash of the integers), ints binary (little-endian 32 bits each)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                ends, ints = fingerprints_of([samples(x, kind, rate) if x else np.zeros(0, np.float32) for x in column(part, media_col).to_pylist()], rate, frame, hop)
                size = np.diff(ends)
                place = spread(np.zeros(len(size), np.int64), size).astype(U)
                sums = []
                for salt in (1, 2):
                    upto = np.concatenate([np.zeros(1, U), np.cumsum(mix(mix(place + U(salt << 40)) ^ ints.astype(U)), dtype=U)])
                    sums.append(mix(upto[ends[1:]] - upto[ends[:-1]] ^ size.astype(U)).view(np.int64))
                blobs = [ints[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([column(part, id_col), pa.array(size.astype(np.int32)), *map(pa.array, sums), pa.array(blobs, pa.binary())], ["id", "n_ints", "fp_a", "fp_b", "ints"])

    return df.select(id_col, media_col).mapInArrow(freeing(run), f"id {id_type}, n_ints int, fp_a long, fp_b long, ints binary")


def packs(classes: DataFrame, most: int) -> DataFrame:
    """ids, ends, ints (binary: 64, 64 and 32 bits each): the classes of each partition in packs of about `most` integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs, held = [], [], 0

        def pack() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) // 4 for x in blobs)], dtype="<i8")
            return pa.RecordBatch.from_pydict({"ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()), "ints": pa.array([b"".join(blobs)], pa.binary())})

        for batch in batches:
            for i, blob in zip(column(batch, "class_id").to_pylist(), column(batch, "ints").to_pylist()):
                ids.append(i)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= most:
                    yield pack()
                    ids, blobs, held = [], [], 0
        if ids:
            yield pack()

    return classes.select("class_id", "ints").mapInArrow(freeing(run), "ids binary, ends binary, ints binary")


def cuts(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive slices of `sizes` that sum to about STEP at most; a larger one is a slice of its own."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, to)
        at = to


@functools.cache
def ball(bits: int, most: int) -> np.ndarray:
    """All numbers of `bits` bits with up to `most` ones."""
    out = np.zeros(1, np.int64)
    for _ in range(min(most, bits)):
        out = np.unique(out[:, None] | np.append(0, 1 << np.arange(bits)))
    return out


def keyed(x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The keys of x: what the tables (one a byte) have for its bits, combined by exclusive or."""
    out = np.zeros(len(x), np.int64)
    for i, t in enumerate(tables):
        out ^= t[(x >> np.uint32(8 * i)).astype(np.uint8)]
    return out


def looked_up(d: np.ndarray, most: int, whole: bool | None = None) -> list[tuple]:
    """Indexes of d (distinct integers) for lookups with up to `most` unequal bits: (mask of the part, bits of its key, tables
    of keys and of hashes, order, ordered integers, start of each key's run, whether a key is there, and a hash) of each part.

    One part, whose key are the bits that differ most among the integers, if that tries fewer keys than lookups by halves, of
    which one has half of the unequal bits at most, would compare integers (or if so told). The hash is of all bits; bits of
    the key turned in it are the same bits turned in the hash.
    """
    size = lambda bits, n: sum(math.comb(bits, k) for k in range(min(n, bits) + 1))
    wide = min(KEY_BITS, len(d).bit_length() + 2)
    runs = [np.bincount(x).astype(float) for x in (d >> np.uint32(16), d & np.uint32(0xFFFF))]
    if whole or whole is None and size(wide, most) < size(16, most // 2) * sum((x * x).sum() for x in runs) / max(1, len(d)):
        some = d[:: 1 + len(d) // 20_000]
        ones = np.array([(some >> np.uint32(b) & np.uint32(1)).mean() for b in range(32)])
        parts = [(0xFFFFFFFF, np.sort(np.argsort(np.abs(ones - 0.5), kind="stable")[:wide]))]
    else:
        parts = [(0xFFFF0000, np.arange(16, 32)), (0x0000FFFF, np.arange(16))]
    out = []
    for mask, bits in parts:
        n = 1 << len(bits)
        chosen = np.zeros(32, np.int64)
        chosen[bits] = 1 << np.arange(len(bits))
        mixed = np.where(chosen, chosen, 0x9E3779B1 * np.arange(1, 33) % n)
        of_bytes = np.arange(256)[:, None] >> np.arange(8) & 1
        tables, hashes = ([np.bitwise_xor.reduce(of_bytes * x[i : i + 8], axis=1) for i in range(0, 32, 8)] for x in (chosen, mixed))
        key = keyed(d, tables)
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        starts, there = np.zeros(n + 1, np.int32), np.zeros((2, n), bool)
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True)[: len(key)])
        starts[key[last] + 1] = last + 1
        np.maximum.accumulate(starts, out=starts)
        there[0, key[last]] = there[1, keyed(d, hashes)] = True
        out.append((np.uint32(mask), len(bits), tables, hashes, order, d[order], starts, *there))
    return out


def near(q: np.ndarray, d: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in q and d (distinct integers) of all pairs with up to `most` unequal bits, each once."""
    for x, y, _ in found(q, most, looked_up(d, most)):
        yield x, y


def found(q: np.ndarray, most: int, index: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As `near`, with the number of unequal bits, in an index for so many or more."""
    least = most // len(index)
    for n, (_, bits, tables, hashes, order, sought, starts, key_there, hash_there) in enumerate(index):
        key, hashed = keyed(q, tables), keyed(q, hashes)
        flips = ball(bits, least)
        turned = np.bitwise_count(flips)
        whole = len(index) == 1  # then what has all its unequal bits in the key is the query but for these, and has its hash
        for flips, known in ((flips[turned < least], False), (flips[turned == least], whole)):
            few = max(1, PROBES // max(1, len(flips)))
            for low in range(0, len(q) if len(flips) else 0, few):
                probe = (key[low : low + few, None] ^ flips).ravel()
                use = np.flatnonzero(key_there[probe])
                who, flip = np.divmod(use, len(flips))
                who += low
                if known:
                    can = np.flatnonzero(hash_there[hashed[who] ^ flips[flip]])
                    use, who = use[can], who[can]
                probe = probe[use]
                first = starts[probe]
                size = starts[probe + 1] - first
                for part in cuts(size):
                    at, asks = spread(first[part], size[part]), np.repeat(who[part], size[part])
                    unequal = sought[at] ^ q[asks]
                    bits_apart = np.bitwise_count(unequal)
                    good = bits_apart <= most
                    for before, *_ in index[:n]:  # the pairs near in an earlier part are given already
                        good &= np.bitwise_count(unequal & before) > least
                    good = np.flatnonzero(good)
                    yield asks[good], order[at[good]], bits_apart[good]


def best_alignments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], most_errors: float, least_overlap: int) -> list[np.ndarray]:
    """id, class_id, offset, overlap, errors, votes of the best admitted alignment of each recording of `a` with each of `b` (ids, ends, ints)."""
    ids, ends, ints = a
    size = np.diff(ends)
    by_size = np.argsort(size, kind="stable")
    ints, ids, size = ints[spread(ends[:-1][by_size], size[by_size])], ids[by_size], size[by_size]
    ends = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(b[2], kind="stable").astype(np.int32)
    d = b[2][order]
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1])[: len(d)]).astype(np.int32)
    d, n = d[first], np.diff(first, append=np.int32(len(d)))
    most, wide = int(32 * most_errors + 1e-9), 2 * (int(size.max(initial=0)) + int(np.diff(b[1]).max(initial=0)) + 1)
    key = np.repeat(wide * np.arange(len(b[0])) + b[1][:-1], np.diff(b[1])) - np.arange(len(b[2]))
    index = wide, order, first, n, n > 1, key, key[order[first]], looked_up(d, most)
    each, at = [], 0
    while at < len(ids) or not each:  # a few recordings at a time: their histograms are whole where they are judged
        to = max(at + 1, min(int(np.searchsorted(ends, ends[at] + TOGETHER, "right")) - 1, at + (1 << 56) // (wide * max(1, len(b[0])))))
        part = ids[at:to], ends[at : to + 1] - ends[at], ints[ends[at] : ends[min(to, len(ids))]]
        each.append(_best_alignments(part, b, index, most_errors, least_overlap))
        at = to
    return [np.concatenate(v) for v in zip(*each)]


def radii(sizes: np.ndarray, most_errors: float, least_overlap: int) -> tuple[np.ndarray, float]:
    """Unequal bits with which each integer of queries of these sizes is looked up, and the weight that admitted offsets have.

    What is not found within r bits is r + 1 bits apart at least. So some vote is found wherever these bits sum up to more
    than an overlap may have, and every second integer may do with one bit less if that holds for all overlaps from the
    least on. Each bit less that a vote has is its weight; an admitted offset's weight is what the sum exceeds its bits by.
    """
    bits, n = 32 * most_errors, np.arange(1, 129)
    most, least = int(bits + 1e-9), np.clip(np.minimum(least_overlap, sizes // 4), 1, 64)
    every_second = most * n + n // 2
    whole = np.logical_and.accumulate((every_second > bits * n + 1e-6)[::-1])[::-1]  # so for all overlaps of n or more
    few = whole[least - 1] & (bits - most <= 0.4)
    place = spread(np.zeros(len(sizes), np.int64), sizes)
    over = every_second if few.any() else (most + 1) * n
    return most - (place % 2 * np.repeat(few, sizes)), float((over - bits * n)[least.min(initial=64) - 1 :].min())


def summed(votes: list[np.ndarray], keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of each one's weights: of votes (64 keys plus weight) and of such sums."""
    both = np.concatenate([*votes, keys << 6])
    if len(keys):
        order = np.argsort(both)
        both, weights = both[order], np.concatenate([*(v & 63 for v in votes), weights])[order]
    else:
        both.sort()
        weights = both & 63
    both >>= 6
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    return both[first], np.add.reduceat(weights, first) if len(first) else weights


def _best_alignments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], index: tuple, most_errors: float, least_overlap: int) -> list[np.ndarray]:
    (ids_a, ends_a, ints_a), (ids_b, ends_b, ints_b) = a, b
    len_a, len_b = np.diff(ends_a), np.diff(ends_b)
    wide, order_b, first_b, n_b, many_b, key_b, at_b, found_in = index
    most = int(32 * most_errors + 1e-9)
    radius, least_weight = radii(len_a, most_errors, least_overlap)
    bits_upto = np.concatenate([[0], np.cumsum(radius + 1)])
    #: With key_b of a class's integer: the number of the two recordings times `wide`, plus the offset and half of `wide`.
    key_a = np.repeat(len(len_b) * wide * np.arange(len(len_a)) - ends_a[:-1] + wide // 2, len_a) + np.arange(len(ints_a))
    kept = [np.zeros(0, np.int64)] * 4 + [np.zeros(0), np.zeros(0, np.int64)]

    def votes() -> Iterator[np.ndarray]:
        """64 keys of recordings and offset plus weight, for each two integers that are found near, at all places that have them."""
        for r in np.unique(radius[radius >= 0]):
            order_a = np.flatnonzero(radius == r)
            order_a = order_a[np.argsort(ints_a[order_a], kind="stable")]
            q, first_a, n_a = np.unique(ints_a[order_a], return_index=True, return_counts=True)
            at_a, many_a = key_a[order_a[first_a]], n_a > 1
            for x, y, apart in found(q, int(r), found_in):
                weight, more = r + 1 - apart, many_a[x] | many_b[y]
                vote = (at_a[x] + at_b[y] << 6) + weight
                if not more.any():
                    yield vote
                    continue
                yield vote[~more]
                x, y, weight = x[more], y[more], weight[more]
                upto = np.concatenate([[0], np.cumsum(n_a[x] * n_b[y])])
                for low in range(0, int(upto[-1]), STEP):
                    nth = np.arange(low, min(low + STEP, upto[-1]))
                    hit = np.searchsorted(upto, nth, "right") - 1
                    nth -= upto[hit]
                    i = order_a[first_a[x[hit]] + nth // n_b[y[hit]]]
                    j = order_b[first_b[y[hit]] + nth % n_b[y[hit]]]
                    yield (key_a[i] + key_b[j] << 6) + weight[hit]

    def best(found: list[np.ndarray]) -> list[np.ndarray]:
        """Of each two recordings the alignment of the lowest rate, then the longest overlap, then the least shift."""
        r, s, offset, overlap, errors, _ = found
        order = np.lexsort((offset, np.abs(offset), -overlap, errors, s, r))
        found = [v[order] for v in found]
        first = np.ones(len(r), bool)
        first[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
        return [v[first] for v in found]

    def judge(key: np.ndarray, weight: np.ndarray | None) -> list[np.ndarray]:
        """The admitted alignments among `key`. Given the whole weight of each, those with too little are not read."""
        if weight is not None:
            use = weight >= least_weight - 1e-6
            key, weight = key[use], weight[use]
        pair, offset = key // wide, key % wide - wide // 2
        r, s = pair // len(len_b), pair % len(len_b)
        start = np.maximum(0, offset)
        overlap = np.minimum(len_a[r], len_b[s] + offset) - start
        use = (ids_a[r] != ids_b[s]) & (overlap >= np.minimum(least_overlap, np.maximum(len_a[r], len_b[s]) // 4))
        if weight is not None:
            from_ = ends_a[r] + start
            use &= bits_upto[from_ + overlap] - bits_upto[from_] - weight <= 32 * most_errors * overlap + 1e-6
        for share in (2, 1):  # what exceeds the errors of the whole in its first half is not read to the end
            r, s, offset, start, overlap = (v[use] for v in (r, s, offset, start, overlap))
            n, errors, near_ones = -(-overlap // share), np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)  # the latter of wholes only
            for part in cuts(n):
                unequal = np.bitwise_count(ints_a[spread((ends_a[r] + start)[part], n[part])] ^ ints_b[spread((ends_b[s] + start - offset)[part], n[part])])
                at = np.cumsum(n[part]) - n[part]
                errors[part] = np.add.reduceat(unequal, at, dtype=np.int64)
                if share == 1:
                    near_ones[part] = np.add.reduceat(unequal <= most, at, dtype=np.int64)
            use = errors / (32 * overlap) <= most_errors
        return [v[use] for v in (r, s, offset, overlap, errors / (32 * overlap), near_ones)]

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    histogram, held, size = none, [], 0
    for vote in votes():
        held.append(vote)
        size += len(vote)
        if size >= STEP:
            histogram, held, size = summed(held, *histogram), [], 0
            if len(histogram[0]) > OFFSETS:  # judged without the bound: more votes of these offsets may be to come
                kept = best([np.concatenate(v) for v in zip(kept, judge(histogram[0], None))])
                histogram = none
    # what has votes from before a judgement was judged then: turning it down by the rest of them changes nothing
    r, s, offset, overlap, errors, near_ones = best([np.concatenate(v) for v in zip(kept, judge(*summed(held, *histogram)))])
    return [ids_a[r], ids_b[s], offset.astype(np.int32), overlap.astype(np.int32), errors, near_ones.astype(np.int32)]


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of unequal bits, integers compared) of b laid over a from a's frame `offset` on (negative: from before it)."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo)), hi - lo


def align(df: DataFrame, media_col: str, kind: str = "wav", rate: int = 11025, frame: int = 4096, hop: int = 1365, id_col: str = "id", every: int = 100, most_errors: float = 0.1, least_overlap: int = 16) -> DataFrame:
    """Classes of recordings and the alignments of the queries, as rows of two kinds.

    `member`: id and its class_id (the smallest id with the same integers), n_ints. `match`: id is the class of a
    recording whose id is divisible by `every`, class_id a class that aligns with it, offset the frame of the query
    where the other starts, overlap the integers compared, errors their bit error rate (at most `most_errors`; the
    overlap is at least `least_overlap` integers, or a quarter of the longer recording where that is less), votes the
    histogram's height there: the overlapping integers with 32 `most_errors` unequal bits at most. Of all admitted offsets of two classes the
    one with the lowest rate is given, then the longest overlap, then the least shift.
    """
    prints = cut_lineage(fingerprints(df, media_col, kind, rate, frame, hop, id_col).withColumn("id", F.col("id").cast("long")))
    key = ["fp_a", "fp_b", "n_ints"]
    usable = prints.where("n_ints > 0 AND id IS NOT NULL")
    classes = cut_lineage(usable.groupBy(*key).agg(F.min("id").alias("class_id"), F.max(F.col("id") % every == 0).alias("asked"), F.first("ints").alias("ints")))
    asked = classes.where("asked")
    in_all, in_asked = (x or 0 for x in classes.agg(F.sum("n_ints"), F.sum(F.when(F.col("asked"), F.col("n_ints")))).first())
    a = cut_lineage(packs(asked.repartition(1 + in_asked // QUERY_PACK), QUERY_PACK)).select(*(F.col(c).alias(f"{c}_a") for c in ("ids", "ends", "ints")))
    pairs = a.hint("shuffle_replicate_nl").crossJoin(cut_lineage(packs(classes.coalesce(1 + in_all // CLASS_PACK), CLASS_PACK)))
    kinds = {"ids": "<i8", "ends": "<i8", "ints": "<u4"}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (tuple(np.frombuffer(column(batch, c + side)[i].as_py(), k) for c, k in kinds.items()) for side in ("_a", ""))
                got = best_alignments(x, y, most_errors, least_overlap)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], ["id", "class_id", "offset", "overlap", "errors", "votes"])

    none = lambda t: F.lit(None).cast(t)
    matches = pairs.mapInArrow(freeing(judge), "id long, class_id long, offset int, overlap int, errors double, votes int")
    members = prints.join(classes.select(*key, "class_id"), key, "left").select(F.lit("member").alias("kind"), "id", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"), "n_ints", none("int").alias("offset"), none("int").alias("overlap"), none("double").alias("errors"), none("int").alias("votes"))
    return members.unionAll(matches.select(F.lit("match"), "id", "class_id", none("int"), "offset", "overlap", "errors", "votes"))
