"""Quality of documents by a convolutional network over bytes, in numpy (operator 12).

Bytes are embedded; learned filters of TAPS bytes look at every STRIDE-th
position of the whole text; responses are max-pooled within chunks of two
blocks, each sharing a block with the next, so chunks overlap by half.  The
greatest and the mean of a document's pooled chunks go through one hidden layer
into one probability.

A second input channel marks bytes that repeat what stood a short way before,
which no filter of a few bytes can see.

The network learns from a bounded, stated sample: ``per_label`` documents of
each label, of each at most SAMPLE_BLOCKS blocks, evenly drawn.  Labels are
drawn equally and the output is shifted by their true frequencies.  Scoring
reads every byte of every text; long texts go through in slices, and what is
held of them is one short vector a block.

Null and empty texts have no chunks and get the network's answer to that; the
byte 0 counts as nothing.  A document with both labels is not learned from, nor
rows without key or text.  Repeated rows score alike.  Without any label, or
with one only, every score is 0.5 or that label's 1 or 0.  An empty table gives
an empty result.  Only the columns in ``keep`` are carried; an input column that
is named as an output is not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsgrid.llm.common import slices

BLOCK = 256                # bytes; a chunk is two blocks
TAPS, STRIDE = 8, 2
CHANNELS, FILTERS, HIDDEN = 7, 24, 16
NEAR = 24                  # how far back a repeated run of 4 bytes is looked for
LEAD, GAP = TAPS, NEAR     # zeros in front of a text and behind it, at least
PER_LABEL = 1500
SAMPLE_BLOCKS = 12
EPOCHS, LEAST_STEPS, BATCH, RATE = 8, 300, 64, 0.01
SLICE_BYTES = 1 << 18
BATCH_BYTES = 1 << 22
OUTPUTS = ("score", "predicted")


def repeats(data: np.ndarray) -> np.ndarray:
    """Whether the 4 bytes from a position on stand in the NEAR bytes before it, too."""
    out = np.zeros(len(data), np.float32)
    if len(data) < 5:
        return out
    wide = data.astype(np.uint32)
    run = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    seen = np.zeros(len(run), bool)
    for back in range(1, min(NEAR, len(run) - 1) + 1):
        seen[back:] |= run[back:] == run[:-back]
    out[:len(run)] = seen & (data[:len(run)] > 0)
    return out


def lay_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each among zeros up to whole blocks, and their numbers of blocks.

    The zeros are so many that no window reaches from one text into another, and no
    repeat is seen in the one before.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks = np.where(sizes > 0, (LEAD + sizes + GAP + BLOCK - 1) // BLOCK, 0)
    data = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    at = (np.cumsum(blocks) - blocks) * BLOCK + LEAD
    for a, t in zip(at.tolist(), texts):
        data[a:a + len(t)] = np.frombuffer(t, np.uint8)
    return data, blocks


def windows(data: np.ndarray, marks: np.ndarray, embedding: np.ndarray, a: int, b: int) -> np.ndarray:
    """The inputs of all filter positions in bytes a to b, one row each."""
    end = min(b + TAPS - STRIDE, len(data))
    x = np.zeros((b - a + TAPS, CHANNELS + 1), np.float32)
    x[:end - a, :CHANNELS] = embedding[data[a:end]]
    x[:end - a, CHANNELS] = marks[a:end]
    view = np.lib.stride_tricks.as_strided(
        x, ((b - a) // STRIDE, TAPS * (CHANNELS + 1)), (x.strides[0] * STRIDE, x.strides[1]))
    return np.ascontiguousarray(view)


class Network:
    """Weights; the embedding of byte 0 stays zero."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        width = TAPS * (CHANNELS + 1)
        self.weights = {
            "embedding": rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32),
            "filters": rng.normal(0, width ** -0.5, (width, FILTERS)).astype(np.float32),
            "hidden": rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32)}
        self.weights["embedding"][0] = 0
        self.shift = 0.0                          # from equally drawn labels to their frequencies
        self.fixed: float | None = 0.5            # the answer to everything while nothing is learned

    def pooled(self, data: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of every filter in every block, floored at 0, and where in the block it is."""
        w, marks = self.weights, repeats(data)
        best = np.zeros((len(data) // BLOCK, FILTERS), np.float32)
        where = np.zeros(best.shape, np.int64)
        for a in range(0, len(data), SLICE_BYTES):
            b = min(a + SLICE_BYTES, len(data))
            response = (windows(data, marks, w["embedding"], a, b) @ w["filters"]).reshape(
                -1, BLOCK // STRIDE, FILTERS)
            rows = slice(a // BLOCK, b // BLOCK)
            if places:
                where[rows] = response.argmax(axis=1)
            best[rows] = np.maximum(response.max(axis=1), 0)
        return best, where

    def features(self, best: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Greatest and mean of each document's chunks, and what the way back needs."""
        out = np.zeros((len(blocks), 2 * FILTERS), np.float32)
        full = np.flatnonzero(blocks)
        if not len(full):
            return out, (full, None, None, None)
        first = (np.cumsum(blocks) - blocks)[full]
        alone = blocks[full] == 1
        left = np.ones(len(best), bool)           # blocks that begin a chunk
        left[(first + blocks[full] - 1)[~alone]] = False
        begin = np.flatnonzero(left)
        single = np.zeros(len(best), bool)
        single[first[alone]] = True
        after = np.where(single[begin], begin, begin + 1)
        chunk = np.maximum(best[begin], best[after])
        n = np.maximum(blocks[full] - 1, 1)
        at = np.cumsum(n) - n
        out[full, :FILTERS] = np.maximum.reduceat(chunk, at, axis=0)
        out[full, FILTERS:] = np.add.reduceat(chunk, at, axis=0) / n[:, None]
        return out, (full, (begin, after), chunk, n)

    def logits(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        inner = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
        return inner @ w["out"] + w["out_bias"][0], inner

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(texts), self.fixed)
        data, blocks = lay_out(texts)
        features, _ = self.features(self.pooled(data)[0], blocks)
        logit = self.logits(features)[0].astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, texts: Sequence[bytes], wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss.  Through the pooling only the greatest responses count."""
        w = self.weights
        data, blocks = lay_out(texts)
        best, where = self.pooled(data, places=True)
        features, (full, pair, chunk, n) = self.features(best, blocks)
        logit, inner = self.logits(features)
        miss = ((1 / (1 + np.exp(-logit)) - wanted) / len(texts)).astype(np.float32)
        d_inner = np.outer(miss, w["out"]) * (inner > 0)
        out = {"out": inner.T @ miss, "out_bias": miss.sum(keepdims=True), "hidden": features.T @ d_inner,
               "hidden_bias": d_inner.sum(axis=0), "filters": np.zeros_like(w["filters"]),
               "embedding": np.zeros_like(w["embedding"])}
        if not len(full):
            return out
        d_features = (d_inner @ w["hidden"].T)[full]
        of = np.repeat(np.arange(len(full)), n)
        d_chunk = (d_features[:, FILTERS:] / n[:, None])[of]
        top = chunk == features[full, :FILTERS][of]
        ties = np.add.reduceat(top, np.cumsum(n) - n, axis=0, dtype=np.float32)
        d_chunk += top * (d_features[:, :FILTERS] / ties)[of]
        begin, after = pair
        d_best = np.zeros_like(best)
        from_left = best[begin] >= best[after]
        np.add.at(d_best, begin, d_chunk * from_left)
        np.add.at(d_best, after, d_chunk * ~from_left)
        d_best *= best > 0
        block, f = np.nonzero(d_best)
        size = d_best[block, f]
        spots = (block * BLOCK + where[block, f] * STRIDE)[:, None] + np.arange(TAPS)
        spots = np.minimum(spots, len(data) - 1)
        seen = data[spots]
        x = np.concatenate([w["embedding"][seen], repeats(data)[spots][..., None]], axis=2)
        for k in range(FILTERS):
            of_filter = f == k
            out["filters"][:, k] = (x[of_filter] * size[of_filter, None, None]).sum(axis=0).ravel()
        back = (w["filters"].T.reshape(FILTERS, TAPS, CHANNELS + 1)[f] * size[:, None, None])[..., :CHANNELS]
        for c in range(CHANNELS):
            out["embedding"][:, c] = np.bincount(seen.ravel(), back[..., c].ravel(), 256)
        out["embedding"][0] = 0
        return out


def fit(sample: Sequence[tuple[bytes, int]], share: float, seed: int = 0) -> Network:
    """A network from texts with labels 0 and 1, of which ``share`` of all labelled documents are 1."""
    net = Network(seed)
    labels = np.array([y for _, y in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.fixed = 0.5 if not len(labels) else float(labels[0])
        return net
    drawn = labels.mean()
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    per_epoch = -(-len(sample) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for a in range(0, len(order), BATCH):
            chosen = order[a:a + BATCH]
            gradient = net.gradients([sample[i][0] for i in chosen], labels[chosen])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in gradient.items():         # Adam
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.weights[k] -= (rate * (first[k] / (1 - 0.9 ** step))
                                   / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    net.shift = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    net.fixed = None
    return net


def excerpt(text: bytes) -> bytes:
    """A text to learn from: itself, or SAMPLE_BLOCKS blocks at even distances."""
    if len(text) <= SAMPLE_BLOCKS * BLOCK:
        return text
    starts = np.linspace(0, len(text) - BLOCK, SAMPLE_BLOCKS).astype(np.int64)
    return b"".join([text[a:a + BLOCK] for a in starts.tolist()])


def learn(docs: DataFrame, labels: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality", per_label: int = PER_LABEL) -> Network:
    """A network from a bounded sample of the labelled rows of ``docs`` where ``train_on`` holds.

    Keys are drawn by their hash: of each label those under a threshold that lets
    ``per_label`` through and some more, of which the driver keeps that many.
    """
    spark = docs.sparkSession
    rows = docs.filter(train_on & docs[key].isNotNull() & docs[text].isNotNull())
    marked = labels.filter(labels[label].isin(0, 1)).groupBy(labels[key].alias("key")).agg(
        F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other AND key IS NOT NULL")
    marked = rows.select(rows[key].alias("key")).distinct().join(marked, "key").select(
        "key", "label", (F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 40)) / (1 << 40)).alias("draw"))
    marked = marked.persist()
    counts = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    under = F.lit(False)
    for value, n in counts.items():
        under = under | ((F.col("label") == value) & (F.col("draw") < min(1.0, 1.2 * (per_label + 50) / n)))
    taken: dict[int, int] = {}
    chosen = []
    for r in sorted(marked.filter(under).collect(), key=lambda r: (r.draw, str(r.key))):
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= per_label:
            chosen.append((r.key, int(r.label)))
    marked.unpersist()
    if not chosen:
        return fit([], 0.5)
    keys = spark.createDataFrame(chosen, T.StructType([T.StructField("key", docs.schema[key].dataType),
                                                       T.StructField("label", T.IntegerType())]))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [excerpt(t.as_buffer().to_pybytes()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(short, pa.binary())],
                                             names=["key", "label", "excerpt"])

    kind = T.StructType([*keys.schema, T.StructField("excerpt", T.BinaryType())])
    # Rows that share a key count once.  At most 2 * per_label rows of 3 kB.
    sample = (rows.select(rows[key].alias("key"), rows[text].alias("_text"))
              .join(F.broadcast(keys), "key").select("key", "label", "_text").mapInArrow(shorten, kind)
              .groupBy("key", "label").agg(F.min("excerpt").alias("excerpt")).collect())
    sample = sorted((bytes(r.excerpt), r.label) for r in sample)
    return fit(sample, counts.get(1, 0) / max(sum(counts.values()), 1))


def classify(docs: DataFrame, net: Network, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (that label 1 holds) and ``predicted`` (1 from a half on)."""
    keep = [c for c in keep if c not in OUTPUTS]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep)).fill_null("")
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, BATCH_BYTES):
                score = shared.value.score([t.as_buffer() for t in column.slice(a, b - a)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(score, pa.float64()),
                     pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*keep, docs[text].alias("_text_to_score")).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: the CRC of the key's text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))
