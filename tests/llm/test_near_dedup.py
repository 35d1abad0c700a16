"""Near-duplicates against brute force over all pairs of shingle sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from terragrid.llm import near_dedup
from terragrid.llm.components import components
from terragrid.llm.queries import op8_near_duplicates

SCHEMA = "doc_id long, text string, id string, bucket string, label string"


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(docs, threshold=0.8):
    """Smallest id of each document's component over links of all pairs, by an inverted index."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for s in index.values():
        for j, b in enumerate(s):
            for a in s[:j]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {i: find(i) for i in sets}


def got_classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_classes(docs)
    assert len(set(want.values())) < len(want)
    assert got_classes(op8_near_duplicates(spark, sf)) == want


def variants(rng, words, base, m, edits):
    out = []
    for _ in range(m):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_large_group_and_chains(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = variants(rng, words, base, 400, 2)  # pairs on both sides of the threshold
    chain = list(base[::-1])
    for _ in range(60):  # neighbours are alike, the ends are not
        chain[rng.randrange(len(chain))] = rng.choice(words)
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(50)] + texts[:30]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in enumerate(texts)], SCHEMA)
    assert got_classes(near_dedup.near_duplicates(df)) == brute_classes(list(enumerate(texts)))


def test_nulls_short_and_repeated(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "a b"), (6, "a  b"), (7, "b a"), (None, "a b"), (8, "x y z u v"), (8, "x y z u v"), (9, "x y z u v"), (10, "x y z u v w")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.keep) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True), (8, 8, True), (9, 8, False), (10, 10, True)]
    left = near_dedup.deduplicated(df)
    assert left.columns == df.columns and left.count() == 10
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signature_agreement_is_the_similarity(weighted):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.uniform(0.3, 9, (2, 300)) if weighted else np.ones((2, 300))
    a, b = np.sort(x[:300]), np.sort(x[100:])
    wa, wb = dict(zip(a.tolist(), w[0])), dict(zip(b.tolist(), w[1]))
    least = sum(min(wa[i], wb[i]) for i in wa if i in wb)
    want = least / (w[0].sum() + w[1].sum() - least)
    sig = near_dedup.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([w[0], w[1]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (sig != 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (310, 300), (300, 305)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, **{i: 300 for i in (300, 305, 310)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("weighted", [True, False])
def test_repeated_lines_weigh(spark, weighted):
    """Texts that differ in how often they repeat a line are alike as sets, and apart by weight; the other way round for edits."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(40):
        line, rest = " ".join(rng.choice(words) for _ in range(9)), " ".join(rng.choice(words) for _ in range(30))
        few = (line + " ") * rng.randrange(2, 6) + rest
        docs += [few, (line + " ") * rng.randrange(10, 40) + rest, few + " " + line, " ".join([line] * 20 + [rng.choice(words) for _ in range(12)])]
        docs.append(" ".join([line] * 20 + [rng.choice(words) for _ in range(12)]))
    docs = list(enumerate(docs))
    want = weighted_classes(docs) if weighted else brute_classes(docs)
    df = spark.createDataFrame([(i, t, None, None, "l") for i, t in docs], SCHEMA)
    assert got_classes(near_dedup.near_duplicates(df, weighted=weighted)) == want
    assert (weighted_classes(docs) != brute_classes(docs)) and len(docs) > len(set(want.values()))


def weighted_classes(docs, threshold=0.8):
    bags = {}
    for i, t in docs:
        w = t.split()
        bags[i] = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and (bags[a] & bags[b]).total() >= threshold * (bags[a] | bags[b]).total() - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in bags}


def by_row(rows, threshold=0.8):
    """Which rows stay: classes over distinct texts, of which the one with the smallest id (of the rows that hold it) stays."""
    least = {}
    for i, t in rows:
        least[t] = min(least.get(t, i), i)
    texts = sorted(least, key=lambda t: (least[t], t))
    classes = brute_classes(list(enumerate(texts)), threshold)
    root = {t: texts[classes[k]] for k, t in enumerate(texts)}
    return Counter((i, t) for i, t in rows if i == least[root[t]])


def test_ids_that_repeat_over_different_and_equal_texts(spark):
    words = [f"w{i}" for i in range(60)]
    t1, t2 = " ".join(words), " ".join(f"v{i}" for i in range(60))
    near = t2 + " more"
    rows = [(2, t1), (5, t1), (5, t2), (7, near), (7, near), (9, t1 + " x"), (9, "something else that nobody else has said"), (11, near), (11, near)]
    df = spark.createDataFrame([(i, t, "x", None, None) for i, t in rows], SCHEMA)
    left = near_dedup.deduplicated(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == by_row(rows)
    assert {r.text for r in left.collect()} == {t1, t2, rows[6][1]}


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-50], *map(str, range(50))])), (3, " ".join(reversed(long))), (4, "short text of five words")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert got_classes(near_dedup.near_duplicates(df)) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_the_largest_component_of_a_bucket_is_not_sent_to_all_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    schema = "bucket long, rep long, n_shingles long, blocks int, label long"
    counts = {}
    for m in (1000, 4000):  # a component of m, 60 members of small components; a bucket of one component, a small bucket
        rows = [(1, i, 9, (m + 60) // 50 + 1, 0 if i < m else i - i % 2) for i in range(m + 60)]
        rows += [(2, i, 9, m // 50, 0) for i in range(m)] + [(3, i, 9, 1, i) for i in range(20)]
        placed = spark.createDataFrame(rows, schema)
        got = near_dedup.across_blocks(placed).collect()
        assert {r.bucket for r in got} == {1}
        groups = {}
        for r in got:
            groups.setdefault((r.i, r.j), []).append(r)
        met = {(x.rep, y.rep) for (i, j), g in groups.items() for x in g for y in g if x.own == i and y.own == j and x.label != y.label}
        met |= {(b, a) for a, b in met}
        label = {r[1]: r[4] for r in rows if r[0] == 1}
        assert all((a, b) in met for a in range(m, m + 60) for b in label if label[a] != label[b])
        counts[m] = len(got)
        once = near_dedup.within_blocks(placed).collect()
        assert len(once) == m + 80 and all(r.i == r.j == r.own for r in once)
    assert counts[4000] <= 4.5 * counts[1000]  # each member to each block: 16 times


def test_rows_compared_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of few members give the classes of brute force, with stragglers on both sides of the threshold."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [t for edits in (1, 2, 3, 4) for t in variants(rng, words, base, 70, edits)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in enumerate(texts)], SCHEMA)
    want = brute_classes(list(enumerate(texts)))
    assert 1 < len(set(want.values())) < len(want)
    assert got_classes(near_dedup.near_duplicates(df)) == want
