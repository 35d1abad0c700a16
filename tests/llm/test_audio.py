"""Fingerprints of synthetic melodies, and the search against brute force over all pairs and offsets."""

import functools
import io
import random
import wave

import numpy as np
import pytest

from terragrid.llm import audio
from terragrid.llm.queries import op5_audio_align

RATE, FRAME, HOP = 8000, 1024, 256


def melody(seed, notes=40, length=1600):
    rng = np.random.default_rng(seed)
    t = np.arange(length) / RATE
    return np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) for p in rng.integers(0, 24, 2)) / 4 for _ in range(notes)])


def wav(x, wide=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(wide)
        w.setframerate(RATE)
        w.writeframes((x * 32000).astype("<i2").tobytes() if wide == 2 else (x * 127 + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def prints(x):
    return audio.fingerprints_of([np.asarray(x, np.float32)], RATE, FRAME, HOP)[1]


def test_noise_and_cuts_change_few_bits():
    x = melody(1)
    rng = np.random.default_rng(2)
    a, b = prints(x), prints(x + rng.normal(0, 0.02, len(x)))
    assert audio.bit_errors(a, b, 0)[0] < 0.12
    cut = prints(x[HOP * 20 + 40 :])
    errors = [audio.bit_errors(a, cut, o)[0] for o in range(-30, 60)]
    assert np.argmin(errors) - 30 == 20 and min(errors) < 0.12
    assert audio.bit_errors(a, prints(melody(9)), 0)[0] > 0.25


def test_integral_image_is_direct_sums():
    x = np.random.default_rng(3).normal(size=FRAME + 40 * HOP)
    whole = prints(x)
    for i in (0, 7, len(whole) - 1):
        assert whole[i] == prints(x[i * HOP : i * HOP + FRAME + 15 * HOP])[0]
    both = audio.fingerprints_of([x.astype(np.float32), np.zeros(0, np.float32), x[: FRAME // 2].astype(np.float32)], RATE, FRAME, HOP)
    assert list(np.diff(both[0])) == [len(whole), 0, 1] and (both[1][: len(whole)] == whole).all()


def test_aligned_recordings_are_found(spark):
    rng = np.random.default_rng(4)
    base = {i: melody(i) for i in range(12)}
    rows = [(i * 100, base[i]) for i in range(12)]
    want = set()
    for i in range(12):
        noisy = base[i][HOP * (5 + i) :] + rng.normal(0, 0.004, len(base[i]) - HOP * (5 + i))
        rows.append((i * 100 + 7, noisy))
        want.add((i * 100, i * 100 + 7, 5 + i))
    rows += [(i * 100 + 3, base[i]) for i in range(3)]
    data = [(i, bytearray(wav(x * 0.9)), None) for i, x in rows] + [(5, None, "x"), (None, bytearray(wav(base[0])), "y"), (6, bytearray(b""), None)]
    df = spark.createDataFrame(data, "id long, media binary, offset string")
    out = audio.align(df, "media", "wav", RATE, FRAME, HOP).collect()
    found = {(r.id, r.class_id, r.offset) for r in out if r.kind == "match" and r.class_id % 100 == 7}
    assert len(found & want) >= 0.9 * len(want) and len(found - want) <= 1
    members = {r.id: r.class_id for r in out if r.kind == "member" and r.id is not None}
    assert members[3] == 0 and members[103] == 100 and members[5] is None and members[6] is None and len([r for r in out if r.kind == "member"]) == len(data)
    assert audio.align(df.limit(0), "media", "wav", RATE, FRAME, HOP).count() == 0


def test_recall_against_brute_force(spark):
    """Texts as 8-bit sound at the query's settings, with edited and cut copies: the truth is every pair at its best offset."""
    rng = random.Random(1)
    docs = {d.doc_id: d.text.encode() for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 2600 AND n_chars < 9000").limit(120).collect()}
    for i in list(docs)[:60]:
        x = bytearray(docs[i])
        for _ in range(rng.randrange(1, 3)):  # edits of a few bytes
            p = rng.randrange(len(x) - 8)
            x[p : p + 6] = bytes(rng.randrange(97, 122) for _ in range(6))
        docs[i + 100_000] = bytes(x[64 * rng.randrange(0, 9) :])
    ids = {k: 10 * k if k < 100_000 else k for k in docs}  # all but the copies are queries
    df = spark.createDataFrame([(ids[i], bytearray(x)) for i, x in docs.items()], "id long, media binary")
    got = {(r.id, r.class_id) for r in audio.align(df, "media", "u8", 8000, 256, 64, every=10).collect() if r.kind == "match"}
    fps = {ids[i]: audio.fingerprints_of([audio.samples(x, "u8")], 8000, 256, 64)[1] for i, x in docs.items()}
    rep = {}
    for i in sorted(fps):
        rep.setdefault(fps[i].tobytes(), i)
    want = set()
    for q in {rep[fps[i].tobytes()] for i in fps if i % 10 == 0}:
        for c in rep.values():
            a, b = fps[q], fps[c]
            if c != q and any(audio.bit_errors(a, b, o)[0] <= 0.1 and audio.bit_errors(a, b, o)[1] >= min(16, max(len(a), len(b)) // 4) for o in range(-len(b), len(a))):
                want.add((q, c))
    assert len(want) > 40
    assert len(want & got) >= 0.9 * len(want), (len(want & got), len(want))
    assert len(got - want) <= 0.1 * len(got)


def test_near_integers_are_all_found():
    rng = np.random.default_rng(5)
    q = np.unique(rng.integers(0, 1 << 32, 200, dtype=np.uint32))
    turned = [x ^ np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, n, dtype=np.uint32)) for x in q for n in (1, 2, 3, 4, 5)]
    d = np.unique(np.concatenate([turned, q[:50]]).astype(np.uint32))
    for most in (0, 1, 3, 4):
        got = [pair for x, y in audio.near(q, d, most) for pair in zip(x.tolist(), y.tolist())]
        want = set(zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(q[:, None] ^ d) <= most))))
        assert len(got) == len(set(got)) and set(got) == want


def test_recordings_without_an_equal_integer_are_found(spark):
    """Short texts and their edited copies: one integer each, unequal in 1 to 3 bits."""
    rng, rows, want = random.Random(6), [], set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars BETWEEN 900 AND 1200").orderBy("doc_id").limit(40).collect():
        text = r.text.encode()[:1200]
        x = bytearray(text)
        for p in rng.sample(range(len(x)), 3):
            x[p] = rng.randrange(97, 122)
        ints = [audio.fingerprints_of([audio.samples(bytes(b), "u8")], 8000, 256, 64)[1] for b in (text, x)]
        if 1 <= np.bitwise_count(ints[0] ^ ints[1]).sum() <= 3:
            assert len(ints[0]) == len(ints[1]) == 1
            rows += [(100 * len(rows), bytearray(text)), (100 * len(rows) + 1, x)]
            want.add((rows[-2][0], rows[-1][0]))
    assert len(want) >= 3
    out = audio.align(spark.createDataFrame(rows, "id long, media binary"), "media", "u8", 8000, 256, 64).collect()
    assert want <= {(r.id, r.class_id) for r in out if r.kind == "match" and r.offset == 0 and r.overlap == 1}


def admitted_pairs(fps, asked, most_errors=0.1, least_overlap=16):
    """Pairs of ids that the query's rule admits at any offset, by the bit errors of all integers against all."""
    ids = sorted(fps)
    size, whole = np.array([len(fps[i]) for i in ids]), np.concatenate([fps[i] for i in ids])
    doc = np.repeat(np.arange(len(ids)), size)
    place = np.arange(len(whole)) - (np.cumsum(size) - size)[doc]
    out = set()
    for q in asked:
        a = fps[q]
        diagonals = size + len(a) - 1
        base = np.cumsum(diagonals) - diagonals
        at = (base[doc] + size[doc] - 1 - place) + np.arange(len(a))[:, None]
        errors = np.bincount(at.ravel(), np.bitwise_count(a[:, None] ^ whole).ravel(), diagonals.sum())
        overlap = np.bincount(at.ravel(), minlength=diagonals.sum())
        least = np.minimum(least_overlap, np.maximum(size, len(a)) // 4)
        good = (errors / (32 * overlap) <= most_errors) & (overlap >= np.repeat(least, diagonals))
        out |= {(q, ids[c]) for c in np.repeat(np.arange(len(ids)), diagonals)[good] if ids[c] != q}
    return out


def test_recall_of_the_query_on_all_lengths_and_offsets(spark):
    """Every document of sf0.01 is a query, with edited and cut copies of all lengths; the truth is the query's own rule."""
    rng = random.Random(7)
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").collect()}
    for i in sorted(docs)[::10]:
        x = bytearray(docs[i])
        for _ in range(1 + len(x) // 2000):
            p = rng.randrange(len(x))
            x[p : p + 4] = bytes(rng.randrange(97, 122) for _ in x[p : p + 4])
        docs[i + 1_000_000] = bytes(x[rng.choice((0, 64, 200, 20 * 64)) % len(x) :])
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in docs.items()], "id long, media binary")
    fps = {}  # the operator's own: levels at a filter's bounds depend on the batch by rounding
    for r in sorted(audio.fingerprints(df, "media", "u8", 8000, 256, 64).collect()):
        fps.setdefault(bytes(r.ints), r.id)
    fps = {i: np.frombuffer(b, np.uint32) for b, i in fps.items()}
    want = admitted_pairs(fps, fps)
    assert len(want) > 100 and len({min(len(fps[a]), 17) for a, _ in want}) > 5
    got = {(r.id, r.class_id) for r in audio.align(df, "media", "u8", 8000, 256, 64, every=1).collect() if r.kind == "match"}
    assert got == want, (len(got & want), len(want), len(got))


def test_a_repeated_passage_does_not_hide_the_true_offset(spark):
    """The repeated passage proposes offset 0 first and most often, where the rest is unequal and the pair is not admitted."""
    rng = np.random.default_rng(8)
    line, rest = (bytes(rng.integers(97, 123, 64 * n, dtype=np.uint8)) for n in (70, 50))
    df = spark.createDataFrame([(100, bytearray(line * 2 + rest)), (7, bytearray(line + rest))], "id long, media binary")
    found = [(r.id, r.class_id, r.offset, r.errors) for r in audio.align(df, "media", "u8", 8000, 256, 64).collect() if r.kind == "match"]
    assert found == [(100, 7, 70, 0.0)]


def test_votes_are_the_height_of_the_offset_histogram(monkeypatch):
    """Best alignments with their votes against all offsets of all pairs, also where the histogram is judged in parts."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    recordings = []
    for i in range(24):
        x = base[(lo := rng.integers(0, 300)) : lo + rng.integers(1, 90)].copy()
        for _ in range(int(rng.integers(0, 4)) * len(x)):
            x[rng.integers(len(x))] ^= np.uint32(1) << np.uint32(rng.integers(32))
        recordings.append(np.concatenate([x, x[:20]]) if i % 3 == 0 else x)
    pack = (np.arange(24), np.cumsum([0, *map(len, recordings)]), np.concatenate(recordings))
    want = {}
    for i, x in enumerate(recordings):
        for j, y in enumerate(recordings):
            rows = []
            for offset in range(-len(y) + 1, len(x)):
                rate, n = audio.bit_errors(x, y, offset)
                if i != j and rate <= 0.1 and n >= min(16, max(len(x), len(y)) // 4):
                    lo = max(0, offset)
                    votes = int((np.bitwise_count(x[lo : lo + n] ^ y[lo - offset : lo - offset + n]) <= 3).sum())
                    rows.append((rate, -n, abs(offset), offset, votes))
            if rows:
                rate, n, _, offset, votes = min(rows)
                want[i, j] = (offset, -n, rate, votes)
    assert len(want) > 20
    for step, offsets in ((1 << 21, 1 << 22), (50, 1 << 22), (50, 20)):
        monkeypatch.setattr(audio, "STEP", step)
        monkeypatch.setattr(audio, "OFFSETS", offsets)
        got = {(int(i), int(j)): tuple(v) for i, j, *v in zip(*(x.tolist() for x in audio.best_alignments(pack, pack, 0.1, 16)))}
        assert got == want


def test_query(spark, sf):
    """Classes are the texts of equal fingerprints; the matches are all that the query's rule admits, by all integers against all."""
    rows = op5_audio_align(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    members = {r.doc_id: r.class_id for r in rows if r.kind == "member"}
    assert set(members) == set(docs)
    fps, by_print = {}, {}
    for i in sorted(docs):
        ints = audio.fingerprints_of([audio.samples((docs[i] or "").encode(), "u8")], 8000, 256, 64)[1]
        assert members[i] == (by_print.setdefault(ints.tobytes(), i) if len(ints) else None)
        if len(ints) and members[i] == i:
            fps[i] = ints
    asked = {members[i] for i in docs if i % 100 == 0 and members[i] is not None}
    matches = [r for r in rows if r.kind == "match"]
    assert {(r.doc_id, r.class_id) for r in matches} == admitted_pairs(fps, asked)
    assert all(0 < r.votes <= r.overlap and audio.bit_errors(fps[r.doc_id], fps[r.class_id], r.offset) == (r.errors, r.overlap) for r in matches)


def test_very_long_recordings_align(spark):
    """2.5 MB each, cut against each other by 1,000 frames."""
    sound = np.random.default_rng(3).integers(97, 123, 2_500_000, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(100, bytearray(sound)), (7, bytearray(sound[64_000:]))], "id long, media binary")
    found = [(r.id, r.class_id, r.offset, r.errors, r.votes == r.overlap) for r in audio.align(df, "media", "u8", 8000, 256, 64).collect() if r.kind == "match"]
    assert found == [(100, 7, 1000, 0.0, True)]


@pytest.mark.parametrize("wide", [1, 2])
def test_wav(wide):
    x = melody(2, 2)
    assert np.abs(audio.samples(wav(x, wide)) - x).max() < 0.02


def test_other_rates_are_brought_to_the_queries(spark):
    x = melody(3, 6)
    n = len(x)
    double = np.interp(np.arange(2 * n) / 2, np.arange(n), x)
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(2 * RATE)
        w.writeframes((double * 32767).astype("<i2").tobytes())
    back = audio.samples(out.getvalue(), "wav", RATE)
    assert len(back) == n and np.corrcoef(back, x)[0, 1] > 0.99
    a, b = (audio.fingerprints_of([v], RATE, FRAME, HOP)[1] for v in (audio.samples(wav(x), "wav", RATE), back))
    assert np.bitwise_count(a ^ b).sum() / (32 * len(a)) < 0.1


def test_fingerprints_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (3000, 1, 500, 20_000)]
    alone = [audio.fingerprints_of([audio.samples(t, "u8")], 8000, 256, 64)[1] for t in texts]
    ends, together = audio.fingerprints_of([audio.samples(t, "u8") for t in texts * 3], 8000, 256, 64)
    for i, want in enumerate(alone * 3):
        assert (together[ends[i] : ends[i + 1]] == want).all()


def test_histograms_are_whole_where_they_are_judged(monkeypatch):
    """Where all queries' offsets outgrow a task's histograms, no more is read than with room for all of them."""
    rng = np.random.default_rng(4)

    def recordings(n, first):
        return np.arange(first, first + n), np.arange(0, 40 * n + 1, 40), rng.integers(0, 1 << 32, 40 * n).astype(np.uint32) & np.uint32(0x03FF03FF)

    a, b = recordings(60, 0), recordings(200, 1000)
    b[2][400:430] = a[2][85:115]  # one alignment
    cuts, read = audio.cuts, []
    monkeypatch.setattr(audio, "cuts", lambda sizes: (read.append(int(sizes.sum())), cuts(sizes))[1])
    want, most = audio.best_alignments(a, b, 0.1, 16), sum(read)
    read.clear()
    monkeypatch.setattr(audio, "OFFSETS", 10_000)
    monkeypatch.setattr(audio, "TOGETHER", 400, raising=False)
    got = audio.best_alignments(a, b, 0.1, 16)
    assert (2, 1010) in set(zip(got[0].tolist(), got[1].tolist()))
    assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(zip(*map(np.ndarray.tolist, want)))
    assert sum(read) <= 1.1 * most


def test_lookups_compare_little_beyond_the_near_integers(monkeypatch):
    """Integers that differ in a few bits only, as those of alike sounds do: lookups by halves compare many that are far apart."""
    rng = np.random.default_rng(12)
    few_bits = np.uint32(0x0F3C_33F0)  # 16 of the 32
    d = np.unique(rng.integers(0, 1 << 32, 60_000, dtype=np.uint32) & few_bits | rng.integers(0, 1 << 32, 60_000, dtype=np.uint32) & np.uint32(0x8000_4081))
    q = np.unique(rng.choice(d, 100))
    cuts, compared = audio.cuts, []
    monkeypatch.setattr(audio, "cuts", lambda sizes: (compared.append(int(sizes.sum())), cuts(sizes))[1])
    pairs = [pair for x, y in audio.near(q, d, 3) for pair in zip(x.tolist(), y.tolist())]
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(q[:, None] ^ d) <= 3))))
    assert sum(compared) <= 4 * len(pairs)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_one_key_finds_all_near_integers(most):
    """As a large table is looked up, by the key and its hash, for as many unequal bits as the index is for and for fewer."""
    rng = np.random.default_rng(13)
    q = np.unique(rng.integers(0, 1 << 32, 150, dtype=np.uint32))
    turned = [x ^ np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, n, dtype=np.uint32)) for x in q for n in (1, 2, 3, 4, 5)]
    d = np.unique(np.concatenate([turned, q[:50]]).astype(np.uint32))
    index = audio.looked_up(d, 4, whole=True)
    assert len(index) == 1
    got = [triple for v in audio.found(q, most, index) for triple in zip(*(x.tolist() for x in v))]
    apart = np.bitwise_count(q[:, None] ^ d)
    want = {(int(x), int(y), int(apart[x, y])) for x, y in zip(*np.nonzero(apart <= most))}
    assert len(got) == len(want) and set(got) == want


def test_lookups_leave_no_room_for_an_admitted_rate():
    """What every overlap's integers are apart if none is found exceeds the bits that the rate admits."""
    for rate in (0.01, 0.03, 0.05, 0.09, 0.1, 0.11, 0.12, 0.2):
        for size in range(1, 70):
            radius, least_weight = audio.radii(np.array([size]), rate, 16)
            upto = np.concatenate([[0], np.cumsum(radius + 1)])
            least = max(1, min(16, size // 4))
            over = [upto[lo + n] - upto[lo] - 32 * rate * n for n in range(least, size + 1) for lo in range(size - n + 1)]
            assert min(over) > 1e-6 and least_weight <= min(over) + 1e-9


def test_alignments_by_one_key_are_those_of_all_offsets(monkeypatch):
    """The test of votes against all offsets, with the index that large packs have."""
    monkeypatch.setattr(audio, "looked_up", functools.partial(audio.looked_up, whole=True))
    test_votes_are_the_height_of_the_offset_histogram(monkeypatch)
