"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed: its first and last 1 to 4 bytes (affixes), all runs of 2 and 3 bytes (n-grams) and the word
itself (lexicon), in lower case and without anything but letters. Emission and transition weights are learned together
from the likelihood of labelled chains; as documents carry one label, half the chains are spliced from two languages, so
that transitions are learned for code-switched text too. Forward-backward gives each word's label probabilities; a
document's are the mean over its words.

Learning uses a bounded sample: about SAMPLE_DOCS documents of each language and SAMPLE_ALL in all (so fewer of each where
there are over 16 languages), chosen by a hash of id and text, and of each of them at most SAMPLE_WORDS words within its
first SAMPLE_CHARS characters, in chains of CHAIN words. The driver sums the gradients of slices of chains: what it holds
at once is bounded by BATCH and by the weights, 1 MB a label. More than MAX_LANGUAGES labels are a ValueError. Prediction covers whole texts, each as one chain: it is worked off in runs of CHAIN words, whose
transfer matrices carry the messages from run to run, so that where a run ends makes no difference. The matrices take 8
bytes times the square of the number of labels for each run of the longest text.

Nulls: a null text, or one without letters, is `und` with score 0; null labels are not learned from; a null id is in no
fold, so it is neither held out nor learned from. Without any labelled text every document is `und`. Repeated rows are
predicted alike. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terragrid.llm.shared import SLICE_BYTES, freeing, slices
from terragrid.llm.text import U, column, mix, spread, words

#: Documents of each language that are learned from, words and characters of each; words of a run; hashed features; languages.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_CHARS, CHAIN, FEATURES, MAX_LANGUAGES = 150, 1000, 20_000, 64, 1 << 16, 256
#: Documents that are learned from in all languages together.
SAMPLE_ALL = 2400
#: Bytes of words whose features are made at once, numbers of a batch of padded runs, and of a slice of learned chains.
FEATURE_BYTES, BATCH, FIT_BATCH = 1 << 19, 1 << 19, 1 << 21
STEPS, RATE, DECAY = 30, 0.1, 1e-3


@dataclass(frozen=True)
class Model:
    """Weights: emissions (FEATURES, labels), transitions (labels, labels)."""

    langs: tuple[str, ...]
    emissions: np.ndarray
    transitions: np.ndarray


class Words:
    """Lower-case letters of distinct words, and their hashed features."""

    def __init__(self, distinct: pa.Array) -> None:
        clean = pc.replace_substring_regex(pc.utf8_lower(distinct.cast(pa.large_string())), r"[^\p{L}]+", "").cast(pa.large_string())
        self.n = len(clean)
        self.off = np.frombuffer(clean.buffers()[1], np.int64)[clean.offset : clean.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = clean.buffers()[2] if self.n else None
        self.raw = np.frombuffer(data, np.uint8) if data is not None and self.off[-1] else np.zeros(0, np.uint8)
        self.letter = np.diff(self.off) > 0

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word number, feature), FEATURE_BYTES of the words at a time; a longer word is in several batches."""
        off, size, whole = self.off, np.diff(self.off), np.zeros(self.n, U)
        hashed = lambda key: (mix(key) % U(FEATURES)).astype(np.int64)

        def key(start: np.ndarray, length: int, kind: int) -> np.ndarray:
            out = np.full(len(start), kind, U)
            for i in range(length):
                out = out * U(257) + self.raw[start + i] + U(1)
            return hashed(out)

        for low in range(int(off[0]), int(off[-1]), FEATURE_BYTES):
            at = np.arange(low, min(low + FEATURE_BYTES, int(off[-1])))
            owner = np.searchsorted(off, at, "right") - 1
            for k in (2, 3):
                ok = at + k <= off[owner + 1]
                yield owner[ok], key(at[ok], k, 1)
            place = (at - off[owner]).astype(U)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            whole[owner[first]] += np.add.reduceat(mix(self.raw[at] + place * U(0x9E3779B97F4A7C15)), first)
        for k in (1, 2, 3, 4):
            ok = np.flatnonzero(size >= k)
            yield ok, key(off[:-1][ok], k, 2)
            yield ok, key(off[1:][ok] - k, k, 3)
        some = np.flatnonzero(size)
        yield some, hashed(whole[some])


def _scores(features: Iterable[tuple[np.ndarray, np.ndarray]], n: int, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]))
    for word, feature in features:
        for y in range(weights.shape[1]):
            out[:, y] += np.bincount(word, weights[feature, y], n)
    return out


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (chains, words, labels) and summed pair probabilities (labels, labels) of padded chains."""
    c, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    now = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = now
    for i in range(1, t):
        nxt = (now @ move) * e[:, i]
        nxt /= nxt.sum(axis=1, keepdims=True)
        now = ahead[:, i] = np.where(mask[:, i, None], nxt, now)
    now = np.ones((c, k))
    for i in range(t - 2, -1, -1):
        prev = (now * e[:, i + 1]) @ move.T
        prev /= prev.sum(axis=1, keepdims=True)
        now = back[:, i] = np.where(mask[:, i + 1, None], prev, now)
    gamma = ahead * back
    gamma /= gamma.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        a, b = ahead[:, i - 1][mask[:, i]], (e[:, i] * back[:, i])[mask[:, i]]
        pairs += move * ((a / ((a @ move) * b).sum(axis=1, keepdims=True)).T @ b)
    return gamma, pairs


def _training_chains(texts: list[str], labels: list[int], seed: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(chains of word numbers, -1 padded; distinct words; labels like the chains)."""
    off, flat = words(pa.array(texts, pa.large_string()))
    coded = flat.dictionary_encode()
    code = np.asarray(coded.indices)
    rng = np.random.default_rng(seed)
    runs = []  # half a chain of one language each
    for i, y in enumerate(labels):
        w = code[off[i] : min(off[i + 1], off[i] + SAMPLE_WORDS)]
        runs += [(w[j : j + CHAIN // 2], y) for j in range(0, len(w), CHAIN // 2)]
    order = rng.permutation(len(runs))
    chains = np.full((len(runs), CHAIN), -1)
    gold = np.full((len(runs), CHAIN), -1)
    for row, i in enumerate(order):
        parts = [runs[i], runs[i + 1] if row % 2 and i + 1 < len(runs) and runs[i + 1][1] == runs[i][1] else runs[order[row - 1]]]
        at = 0
        for w, y in parts:
            w = w[rng.integers(0, 3) :] if len(w) > 8 else w
            chains[row, at : at + len(w)] = w
            gold[row, at : at + len(w)] = y
            at += len(w)
    return chains, coded.dictionary, gold


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Model:
    """Learns from labelled texts by gradient steps (Adam) on the conditional likelihood."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        return Model((), np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)))
    k = len(langs)
    chains, distinct, gold = _training_chains(texts, [langs.index(x) for x in labels], seed)
    use = (chains >= 0).any(axis=1)
    chains, gold = chains[use], gold[use]
    first, feature = _features_by_word(distinct)
    few = max(1, FIT_BATCH // (CHAIN * k))
    slices_ = []  # of each slice of chains: its distinct words, where its chains have them, and its labels
    for low in range(0, len(chains), few):
        mask = chains[low : low + few] >= 0
        used, code = np.unique(chains[low : low + few][mask], return_inverse=True)
        place = np.zeros(mask.shape, np.int32)
        place[mask] = code
        slices_.append((used, place, mask, gold[low : low + few]))
    follow = (gold[:, :-1] >= 0) & (gold[:, 1:] >= 0)
    seen_pairs = np.bincount(gold[:, :-1][follow] * k + gold[:, 1:][follow], minlength=k * k).reshape(k, k)
    emissions, transitions = np.zeros((k, FEATURES), np.float32), np.zeros((k, k))
    total = max(int((chains >= 0).sum()), 1)
    moments = [tuple(np.zeros_like(p) for _ in range(2)) for p in (emissions, transitions)]

    def climb(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> None:
        g = g / total - DECAY * p / total * 100
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    for step in range(1, STEPS + 1):
        up, pairs = np.zeros_like(emissions), seen_pairs.astype(float)
        for used, place, mask, own in slices_:
            size = first[used + 1] - first[used]
            owner, features = np.repeat(np.arange(len(used)), size), feature[spread(first[used], size)]
            scores = np.stack([np.bincount(owner, emissions[y][features], len(used)) for y in range(k)], axis=1)
            gamma, expected = forward_backward(scores[place] * mask[..., None], mask, transitions)
            pairs -= expected
            miss = -gamma[mask]
            miss[np.arange(len(miss)), own[mask]] += 1
            for y in range(k):
                up[y] += np.bincount(features, np.bincount(place[mask], miss[:, y], len(used))[owner], FEATURES)
        for y in range(k):
            climb(emissions[y], up[y], moments[0][0][y], moments[0][1][y], step)
        climb(transitions, pairs, *moments[1], step)
    return Model(langs, np.ascontiguousarray(emissions.T), transitions)


def _features_by_word(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each word's features start, and the end; features word by word)."""
    parts = [(w.astype(np.int32), f.astype(np.uint16 if FEATURES <= 1 << 16 else np.int32)) for w, f in Words(distinct).features()]
    word, feature = (np.concatenate(x) for x in zip(*parts))
    return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(distinct)))]), feature[np.argsort(word, kind="stable")]


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text, modulo `folds`, is `fold`; false for null."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> Model:
    """A model of the rows that are not held out; the sample's bound does not depend on the table's size."""
    usable = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return fit([], [])
    each = min(SAMPLE_DOCS, max(1, SAMPLE_ALL // len(counts)))
    draw = F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 1.2 * each / r["count"]))]), F.col("lang"))
    head = F.array_join(F.slice(F.split(F.substring("text", 1, SAMPLE_CHARS), r"[\x20\x09-\x0D]+"), 1, SAMPLE_WORDS + 1), " ")  # a first separator gives an empty word
    rows = usable.withColumn("draw", draw).where(F.col("draw") < rate).select("lang", head.alias("text"), "draw", "id").orderBy("draw", "id", "text").limit(2 * each * len(counts)).collect()
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        if len(mine := by_lang.setdefault(r.lang, [])) < each:
            mine.append(r.text)
    return fit([t for x in sorted(by_lang) for t in by_lang[x]], [x for x in sorted(by_lang) for _ in by_lang[x]], seed)


def _word_probabilities(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(offsets of each text's words, probabilities of each word, the words, whether each has a letter)."""
    off, flat = words(texts)
    coded = flat.dictionary_encode()
    code = np.asarray(coded.indices)
    distinct, k = Words(coded.dictionary), len(model.langs)
    if not len(code) or not k:
        return off, np.zeros((len(code), k)), flat, distinct.letter[code]
    scores = _scores(distinct.features(), distinct.n, model.emissions)
    count = -(-np.diff(off) // CHAIN)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(count)), count)
    start = off[owner] + CHAIN * (np.arange(first[-1]) - first[owner])
    length = np.minimum(CHAIN, off[owner + 1] - start)

    def runs(chosen: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(runs, their words' places, mask, scores), in batches; `width` is the size of what is worked out for a run."""
        step = max(1, BATCH // width)
        for i in range(0, len(chosen), step):
            rows = chosen[i : i + step]
            mask = np.arange(length[rows].max()) < length[rows][:, None]
            at = np.where(mask, start[rows][:, None] + np.arange(mask.shape[1]), 0)
            yield rows, at, mask, scores[code[at]]

    enter, leave = np.ones((len(owner), k)), np.ones((len(owner), k))
    long = np.flatnonzero(count[owner] > 1)
    if len(long):
        through = np.empty((len(long), k, k))
        place = np.full(len(owner), -1)
        place[long] = np.arange(len(long))
        for rows, _, mask, own in runs(long, CHAIN * k + k * k):
            through[place[rows]] = _transfer(own, mask, model.transitions)
        move = np.exp(model.transitions - model.transitions.max())
        texts_ = np.flatnonzero(count > 1)
        texts_ = texts_[np.argsort(-count[texts_], kind="stable")]
        more = np.searchsorted(-count[texts_], -np.arange(1, count.max()), "left")  # texts of more than j runs, j from 1 on
        for j, m in enumerate(more, 1):
            rows = first[texts_[:m]] + j - 1
            message = np.einsum("ci,cij->cj", enter[rows], through[place[rows]]) @ move
            enter[rows + 1] = message / message.sum(axis=1, keepdims=True)
        for j, m in reversed(list(enumerate(more, 1))):
            rows = first[texts_[:m]] + j
            message = np.einsum("cij,cj->ci", through[place[rows]], leave[rows]) @ move.T
            leave[rows - 1] = message / message.sum(axis=1, keepdims=True)
    out = np.empty((len(code), k))
    for low, high in ((0, 8), (8, 24), (24, CHAIN)):  # runs of like length, so that little is padded
        for rows, at, mask, own in runs(np.flatnonzero((length > low) & (length <= high)), high * k):
            out[at[mask]] = _marginals(own, mask, model.transitions, enter[rows], leave[rows])[mask]
    return off, out, flat, distinct.letter[code]


def _transfer(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """(runs, labels, labels): what a run makes of each label's message into it, up to a factor."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    now = np.eye(e.shape[2]) * e[:, :1]
    for i in range(1, e.shape[1]):
        nxt = (now @ move) * e[:, i, None]
        now = np.where(mask[:, i, None, None], nxt / nxt.sum(axis=(1, 2), keepdims=True), now)
    return now


def _marginals(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray, enter: np.ndarray | float = 1.0, leave: np.ndarray | float = 1.0) -> np.ndarray:
    """Label probabilities of each word of padded runs, given the messages into their first words and back into their last."""
    c, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead = np.empty_like(e)
    now = enter * e[:, 0]
    now = ahead[:, 0] = now / now.sum(axis=1, keepdims=True)
    for i in range(1, t):
        nxt = (now @ move) * e[:, i]
        now = ahead[:, i] = np.where(mask[:, i, None], nxt / nxt.sum(axis=1, keepdims=True), now)
    now = leave * np.ones((c, k))
    ahead[:, t - 1] *= now
    for i in range(t - 2, -1, -1):
        prev = (now * e[:, i + 1]) @ move.T
        now = np.where(mask[:, i + 1, None], prev / prev.sum(axis=1, keepdims=True), now)
        ahead[:, i] *= now
    return ahead / ahead.sum(axis=2, keepdims=True)


def document_labels(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(label, its mean probability over the words with letters) of each text."""
    off, p, _, letter = _word_probabilities(texts, model)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(off))
    count = np.bincount(text[letter], minlength=n)
    if not model.langs:
        return ["und"] * n, np.zeros(n)
    mean = np.stack([np.bincount(text[letter], p[letter, y], n) for y in range(len(model.langs))], axis=1) / np.maximum(count, 1)[:, None]
    best = mean.argmax(axis=1)
    return [model.langs[b] if c else "und" for b, c in zip(best, count)], np.where(count > 0, np.clip(mean[np.arange(n), best], 0, 1), 0.0)


def predict(df: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`df` with the label and score of each row; columns of these names are replaced. Python gets the texts only."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    @freeing
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [document_labels(part, sent.value) for part in _steps(texts, sent.value)]
            yield pa.StructArray.from_arrays([pa.array([x for label, _ in found for x in label], pa.string()), pa.array(np.concatenate([np.zeros(0), *(s for _, s in found)]))], ["label", "score"])

    kept = [F.col(f"`{c}`") for c in df.columns if c not in (pred_col, score_col)]
    out = df.select(F.struct(*kept).alias("row"), judge(F.col(text_col)).alias("judged"))
    return out.select("row.*", F.col("judged.label").alias(pred_col), F.col("judged.score").alias(score_col))


def _slice_bytes(model: Model) -> int:
    """Bytes of text worked off at once: fewer where words have probabilities of over 16 languages."""
    return SLICE_BYTES * 16 // max(16, len(model.langs))


def _steps(texts: pa.Array, model: Model) -> Iterator[pa.Array]:
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", _slice_bytes(model)):
        yield part.column("text")


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words array<string>, labels array<string> of each text: labels word by word, for code-switched text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = sent.value
            for part in slices(batch, text_col, _slice_bytes(m)):
                off, p, flat, letter = _word_probabilities(column(part, text_col), m)
                names = np.array([*m.langs, "und"], object)
                label = names[np.where(letter, p.argmax(axis=1), len(m.langs))] if m.langs else np.full(len(flat), "und", object)
                ends = pa.array(off.astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(part, id_col), pa.ListArray.from_arrays(ends, flat.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(label, pa.string()))], ["id", "words", "labels"])

    return df.select(id_col, text_col).mapInArrow(freeing(run), f"id {id_type}, words array<string>, labels array<string>").withColumnRenamed("id", id_col)


def certainties(texts: pa.Array, model: Model) -> np.ndarray:
    """The mean over each text's words with letters of the word's best probability, 1 where no language was learned; 0 without letters."""
    off, p, _, letter = _word_probabilities(texts, model)
    text = np.repeat(np.arange(len(texts)), np.diff(off))[letter]
    count = np.bincount(text, minlength=len(texts))
    best = p[letter].max(axis=1) if model.langs else np.ones(len(text))
    return np.bincount(text, best, len(texts)) / np.maximum(count, 1)


def known_language(df: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text has a letter and words of known languages: of certainty `least` or more, in one language or several."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    @freeing
    def certainty(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(certainties(part, sent.value) for part in _steps(texts, sent.value))]))

    sure = certainty(F.col(text_col)).alias("sure")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), sure).where((F.col("sure") > 0) & (F.col("sure") >= least)).select("row.*")
