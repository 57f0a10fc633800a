"""Language ID by a linear-chain conditional random field (operator 4).

Words are what stands between white space, in lower case, without marks.  A word
has hashed features: its affixes, its letter n-grams, and itself if it is in the
lexicon of frequent words.  Transitions between the labels of neighbouring words
are learned, so a text in several languages is labelled word by word.  Marginals
come from forward-backward over whole texts: chunks of words are folded into
transfer matrices, which carry the sums from chunk to chunk, so long texts and
short ones are computed side by side.  A text's language is the one with the
most probability over its words, and the score is its share.

The model is fitted on a bounded sample of labelled rows: every label has
``per_label`` of them, or an equal part of SAMPLE_ROWS if there are many labels,
but LEAST_ROWS at least, with some runs of words from all over each text.
Rows are drawn by a hash of key and text, so keys may be null or repeat.
Training sequences join runs of different labels.  The model's size grows with
the number of labels; no label is left out.

A null text and a text without a letter are ``und`` with score 0, as is every
text if no row is labelled.  Repeated rows get the same result.  An empty table
gives an empty result.  Input columns named as an output are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsgrid.llm.common import materialise, slices

UND = "und"
PER_LABEL = 1000
SAMPLE_ROWS, LEAST_ROWS = 64_000, 50
FOLDED = 64            # with more labels, transfer matrices cost more than steps along the texts
RUNS, RUN_WORDS, RUNS_JOINED = 4, 16, 3
HASHED = 1 << 16
LEXICON = 20_000
EPOCHS, BATCH, RATE = 4, 256, 0.5
CHUNK = 32
BATCH_CHARS = 1 << 19
FEATURE_WORDS = 1 << 14
CACHE_WORDS = 200_000


def letters(word: str) -> str:
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def features(words: Sequence[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words given by their letters, and the word that each belongs to.

    A word has its 2- and 3-grams with its edges marked, its first and last one to
    three letters, and itself or a mark that it isn't in the lexicon.  Words
    without a letter have none.
    """
    full = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)))
    texts = [f"^{words[i]}$" for i in full]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(full, sizes)
    end = np.cumsum(sizes)
    begin = end - sizes
    left = np.repeat(end, sizes) - np.arange(len(chars))      # characters from here to the end

    def hashed(at: np.ndarray, n: int, salt: int) -> np.ndarray:
        code = np.full(len(at), salt, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                code = (code + chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
        return (code >> np.uint64(17)).astype(np.int64) & (HASHED - 1)

    ids, owners = [], []
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        ids.append(hashed(at, n, n))
        owners.append(of[at])
    for n in (1, 2, 3):
        long = sizes >= n + 2
        for at, salt in ((begin[long] + 1, 10 + n), (end[long] - 1 - n, 20 + n)):
            ids.append(hashed(at, n, salt))
            owners.append(full[long])
    ids.append(np.fromiter((crc32(words[i].encode()) & (HASHED - 1) if words[i] in lexicon else 0
                            for i in full), np.int64, len(full)))
    owners.append(full)
    return np.concatenate(ids), np.concatenate(owners)


def step_by_step(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray):
    """``forward_backward`` from word to word, all texts side by side."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    begin, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    longest = int(sizes.max(initial=0))
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")     # texts with a word there
    forward, backward = np.empty_like(e), np.empty_like(e)
    state = np.full((len(sizes), k), 1 / k)
    for t in range(longest):
        at, on = begin[:going[t]] + t, slice(going[t])
        state[on] = (state[on] @ step) * e[at]
        state[on] /= state[on].sum(axis=1, keepdims=True)
        forward[at] = state[on]
    state = np.full((len(sizes), k), 1 / k)
    for t in reversed(range(longest)):
        at, on = begin[:going[t]] + t, slice(going[t])
        backward[at] = state[on]
        state[on] = (e[at] * state[on]) @ step.T
        state[on] /= state[on].sum(axis=1, keepdims=True)
    marginal = forward * backward
    return forward, backward, marginal / marginal.sum(axis=1, keepdims=True)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Forward and backward sums and marginals of each word; ``lengths`` are of texts end to end.

    Sums are scaled to 1 a word.
    """
    n, k = scores.shape
    step = np.exp(transitions - transitions.max())
    if k > FOLDED:
        return step_by_step(scores, lengths, step)
    chunks = -(-lengths // CHUNK)
    m = int(chunks.sum())
    begin = np.cumsum(chunks) - chunks
    word = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(begin, lengths) + word // CHUNK
    col = word % CHUNK
    e = np.ones((m, CHUNK, k))
    e[row, col] = np.exp(scores - scores.max(axis=1, keepdims=True))
    there = np.zeros((m, CHUNK, 1), bool)
    there[row, col] = True

    def scaled(x: np.ndarray, axes) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    fold = np.broadcast_to(np.eye(k), (m, k, k))
    for t in range(CHUNK):
        fold = np.where(there[:, t, :, None], scaled((fold @ step) * e[:, t, None, :], (1, 2)), fold)
    ahead, behind = np.full((m, k), 1 / k), np.full((m, k), 1 / k)
    for j in range(1, int(chunks.max(initial=0))):
        at = begin[chunks > j] + j
        ahead[at] = scaled(np.einsum("mi,mij->mj", ahead[at - 1], fold[at - 1]), 1)
        at = (begin + chunks)[chunks > j] - j
        behind[at - 1] = scaled(np.einsum("mij,mj->mi", fold[at], behind[at]), 1)
    forward, backward = np.empty_like(e), np.empty_like(e)
    for t in range(CHUNK):
        ahead = np.where(there[:, t], scaled((ahead @ step) * e[:, t], 1), ahead)
        forward[:, t] = ahead
    for t in reversed(range(CHUNK)):
        backward[:, t] = behind
        behind = np.where(there[:, t], scaled((e[:, t] * behind) @ step.T, 1), behind)
    forward, backward = forward[row, col], backward[row, col]
    return forward, backward, scaled(forward * backward, 1)


class Model:
    """Labels, lexicon, feature weights and transitions."""

    def __init__(self, labels: list[str], lexicon: frozenset[str]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((HASHED, len(labels)), np.float32)
        self.transitions = np.zeros((len(labels), len(labels)))

    def scores(self, words: Sequence[str]) -> np.ndarray:
        if len(words) > FEATURE_WORDS:
            return np.concatenate([self.scores(words[a:a + FEATURE_WORDS])
                                   for a in range(0, len(words), FEATURE_WORDS)])
        ids, of = features([letters(w) for w in words], self.lexicon)
        return np.stack([np.bincount(of, self.weights[ids, j], len(words))
                         for j in range(len(self.labels))], axis=1) if self.labels else \
            np.zeros((len(words), 0))


def fit(runs: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Gradient ascent on the likelihood of sequences joined from labelled runs of words."""
    labels = sorted({label for label, _ in runs})
    seen: dict[str, int] = {}
    for _, words in runs:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    frequent = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[:LEXICON]
    model = Model(labels, frozenset(frequent))
    if not labels:
        return model
    number = {label: i for i, label in enumerate(labels)}
    index = {w: i for i, w in enumerate(seen)}
    flat, of = features(list(seen), model.lexicon)
    flat = flat[np.argsort(of, kind="stable")]
    counts = np.bincount(of, minlength=len(seen))
    first = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    k = len(labels)
    power, power_t = np.full((HASHED, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for a in range(0, len(order), BATCH * RUNS_JOINED):
            chosen = [runs[i] for i in order[a:a + BATCH * RUNS_JOINED]]
            words = np.array([index[w] for _, ws in chosen for w in ws])
            gold = np.repeat([number[label] for label, _ in chosen], [len(ws) for _, ws in chosen])
            sizes = np.add.reduceat([len(ws) for _, ws in chosen],
                                    np.arange(0, len(chosen), RUNS_JOINED))
            n_features = counts[words]
            at = np.repeat(first[words] - (np.cumsum(n_features) - n_features), n_features)
            used = flat[at + np.arange(n_features.sum())]
            of = np.repeat(np.arange(len(words)), n_features)
            scores = np.stack([np.bincount(of, model.weights[used, j], len(words))
                               for j in range(k)], axis=1)
            forward, backward, marginal = forward_backward(scores, sizes, model.transitions)
            miss = -marginal
            miss[np.arange(len(words)), gold] += 1
            gradient = np.stack([np.bincount(used, miss[of, j], HASHED) for j in range(k)], axis=1)
            inner = np.ones(len(words), bool)
            inner[np.cumsum(sizes) - sizes] = False
            later = np.flatnonzero(inner)
            step = np.exp(model.transitions)
            ahead = forward[later - 1]
            behind = np.exp(scores[later] - scores[later].max(axis=1, keepdims=True)) * backward[later]
            ahead = ahead / ((ahead @ step) * behind).sum(axis=1, keepdims=True)
            gradient_t = -step * (ahead.T @ behind)
            np.add.at(gradient_t, (gold[later - 1], gold[later]), 1)
            power += gradient ** 2
            power_t += gradient_t ** 2
            model.weights += (RATE * gradient / np.sqrt(power)).astype(np.float32)
            model.transitions += RATE * gradient_t / np.sqrt(power_t)
    return model


def sample_runs(labelled: DataFrame, key: Column, per_label: int = PER_LABEL) -> list:
    """Labelled runs of words from a bounded sample of ``labelled`` (``label``, ``text``)."""
    drawn = labelled.withColumn("draw", F.xxhash64(key, "text"))
    draws = materialise(drawn.select("label", "draw").distinct(), "draws")
    n_labels = draws.select("label").distinct().count()
    if not n_labels:
        return []
    most = max(min(per_label, LEAST_ROWS), min(per_label, SAMPLE_ROWS // n_labels))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw"))
    draws = draws.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, runs = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in map(letters, (text or "").lower().split()) if w]
                starts = np.linspace(0, max(len(words) - RUN_WORDS, 0), RUNS).astype(int)
                for a in sorted({*starts.tolist()}):
                    if words[a:a + RUN_WORDS]:
                        label.append(name)
                        runs.append([w[:64] for w in words[a:a + RUN_WORDS]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.string()), pa.array(runs, pa.list_(pa.string()))],
                names=["label", "words"])

    # Distinct runs: copies of one row, drawn together, count once.
    rows = (drawn.join(F.broadcast(draws), ["label", "draw"]).select("label", "text")
            .mapInArrow(cut, "label string, words array<string>").distinct().collect())
    return sorted((r.label, list(r.words)) for r in rows)


class Rows(dict):
    """Words to rows of a table of scores, which is filled in after new words are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.table = np.zeros((0, len(self.model.labels)))
        self.lettered = np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = row = len(self)
        return row

    def fill(self) -> None:
        if self.new:
            self.table = np.concatenate([self.table, self.model.scores(self.new)])
            self.lettered = np.concatenate([self.lettered, [bool(letters(w)) for w in self.new]])
            self.new = []


def label_texts(rows: Rows, texts: Sequence[str]) -> list[tuple[str, float]]:
    """The language and score of every text."""
    labels = rows.model.labels
    if len(rows) > CACHE_WORDS * FOLDED // max(FOLDED, len(labels)):
        rows.reset()
    split = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    at = np.fromiter(map(rows.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
    rows.fill()
    out = [(UND, 0.0)] * len(texts)
    full = np.flatnonzero(lengths)
    if not labels or not len(full):
        return out
    _, _, marginal = forward_backward(rows.table[at], lengths[full], rows.model.transitions)
    marginal = marginal * rows.lettered[at][:, None]
    mass = np.add.reduceat(marginal, (np.cumsum(lengths) - lengths)[full], axis=0)
    total = mass.sum(axis=1)
    for i, best, part, whole in zip(full, mass.argmax(axis=1), mass.max(axis=1), total):
        if whole > 0:
            out[i] = (labels[best], float(min(part / whole, 1.0)))
    return out


def identify(df: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text",
             label: str = "lang", keep: Sequence[str] = ("doc_id",),
             per_label: int = PER_LABEL,
             outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score``; learns from rows with a label where ``train_on`` holds.

    ``outputs`` gives the two new columns other names.
    """
    keep = [c for c in keep if c not in outputs]
    labelled = df.filter(train_on & df[label].isNotNull() & df[text].isNotNull()).select(
        df[label].alias("label"), df[text].alias("text"), df[key].cast("string").alias("key"))
    model = df.sparkSession.sparkContext.broadcast(
        fit(sample_runs(labelled, F.col("key"), per_label)))
    schema = T.StructType([*df.select(*keep).schema, T.StructField(outputs[0], T.StringType()),
                           T.StructField(outputs[1], T.DoubleType())])
    own = text in keep                            # then the text isn't handed over twice
    at = keep.index(text) if own else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(model.value)
        most = BATCH_CHARS * FOLDED // max(FOLDED, len(rows.model.labels))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), most):
                found = label_texts(rows, texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(keep))),
                     pa.array([x for x, _ in found], pa.string()),
                     pa.array([x for _, x in found], pa.float64())], names=schema.names)

    handed = df.select(*keep) if own else df.select(*keep, df[text].alias("_text_to_label"))
    return handed.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: the CRC of the key's text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def drop_unidentified(docs: DataFrame, train_on: Column, least: float = 0.4) -> DataFrame:
    """``docs`` without texts that are ``und`` or whose language has a score below ``least``."""
    free = "_"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    found = identify(docs, train_on, keep=docs.columns, outputs=(free + "lang", free + "score"))
    return found.filter((F.col(free + "lang") != UND) & (F.col(free + "score") >= least)) \
        .select(docs.columns)
