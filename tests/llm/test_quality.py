import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import quality as m
from newsgrid.llm.queries import QUERIES
from newsgrid.llm.quality import Network, classify, excerpt, fit, learn, lay_out, repeats


def plain_score(net, text):
    """The network's answer position by position."""
    w = net.weights
    best = []
    data = [0] * m.LEAD + list(text) + [0] * m.GAP
    data += [0] * (-len(data) % m.BLOCK) if text else []
    marks = [any(data[i:i + 4] == data[i - b:i - b + 4] for b in range(1, m.NEAR + 1) if i >= b)
             and data[i] and i + 4 <= len(data) for i in range(len(data))]
    for a in range(0, len(data) if text else 0, m.BLOCK):
        top = np.zeros(m.FILTERS)
        for i in range(a, a + m.BLOCK, m.STRIDE):
            x = np.concatenate([np.append(w["embedding"][data[j]], marks[j]) if j < len(data)
                                else np.zeros(m.CHANNELS + 1) for j in range(i, i + m.TAPS)])
            top = np.maximum(top, x @ w["filters"])
        best.append(top)
    chunks = [np.maximum(x, y) for x, y in zip(best, best[1:])] or best
    features = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) if chunks \
        else np.zeros(2 * m.FILTERS)
    inner = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
    return 1 / (1 + np.exp(-(inner @ w["out"] + w["out_bias"][0] + net.shift)))


def made(seed=1):
    net = Network(seed)
    net.fixed, net.shift = None, 0.3
    net.weights["hidden_bias"] += 0.1
    return net


TEXTS = [b"", b"a", b"the the the the", "Wörter ".encode() * 40, bytes(range(256)) * 4, b"x" * 249, b"x" * 250,
         b"\0\0", b"one line | two | three\n" * 70]


def test_score_equals_plain(monkeypatch):
    net = made()
    want = [plain_score(net, t) for t in TEXTS]
    assert np.allclose(net.score(TEXTS), want, atol=1e-5)
    assert np.allclose([net.score([t])[0] for t in TEXTS], want, atol=1e-5)
    monkeypatch.setattr(m, "SLICE_BYTES", m.BLOCK)
    assert np.allclose(net.score(TEXTS), want, atol=1e-5)


def test_gradients_by_differences():
    net = made(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    wanted = np.array([i % 2 for i in range(len(TEXTS))], float)

    def loss():
        data, blocks = lay_out(TEXTS)
        z = net.logits(net.features(net.pooled(data)[0], blocks)[0])[0]
        return float(np.mean(np.logaddexp(0, z) - wanted * z))

    got = net.gradients(TEXTS, wanted)
    rng = np.random.default_rng(0)
    for name, weights in net.weights.items():
        near = 0
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if name == "embedding":
                at = (int(rng.choice(list(b"thelin |\n"))), at[1])
            held, eps = weights[at], 2e-3
            weights[at] = held + eps
            up = loss()
            weights[at] = held - eps
            down = loss()
            weights[at] = held
            near += abs((up - down) / (2 * eps) - got[name][at]) < 2e-4 + 0.05 * abs(got[name][at])
        assert near >= 11, name                   # a kink of the pooling may lie between


def test_repeats_and_excerpt():
    assert repeats(np.frombuffer(b"abcdabcdx", np.uint8)).tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    far = b"abcd" + bytes(range(100, 100 + m.NEAR)) + b"abcd"
    assert not repeats(np.frombuffer(far, np.uint8)).any()
    assert excerpt(b"x" * 100) == b"x" * 100
    assert len(excerpt(b"x" * 10 ** 6)) == m.SAMPLE_BLOCKS * m.BLOCK


def rows(n=240):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
        out.append((i, (" ".join if i % 3 else "$ ".join)(words), "x", 7))
    return out


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(m, "LEAST_STEPS", 120)
    docs = rows() + [(None, None, None, None), (900, None, "x", 7), (901, "", "x", 7), (901, "", "x", 7),
                     (902, "long words " * 200_000, "x", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(240)] + [(5, 0, 0), (None, 1, 0), (10 ** 6, 0, 0), (7, None, 0)],
        "doc_id long, quality int, label int")
    net = learn(df, labels, F.col("doc_id") < 160)
    assert abs(net.shift) < 0.1                   # nearly all are drawn: frequencies as they are
    found = classify(df, net, keep=df.columns)
    assert found.columns == ["doc_id", "text", "label", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got if r.doc_id and r.doc_id < 240]) > 0.97
    assert classify(df.limit(0), net).count() == 0
    for only, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1 AND doc_id <> 5"), 1.0)):
        assert {r.score for r in classify(df, learn(df, only, F.lit(True))).collect()} == {want}
    assert learn(df.limit(0), labels, F.lit(True)).fixed == 0.5


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(m, "fit", lambda sample, share: seen.append((sample, share)))
    docs = [(i, f"text {i} " + "y" * 50_000) for i in range(300)] + [(3, "another"), (3, "third")] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(300)] * 2, "doc_id long, quality int")
    learn(df, labels, F.lit(True), per_label=40)
    (sample, share), = seen
    assert [sum(y == k for _, y in sample) for k in (0, 1)] == [40, 40] and abs(share - 2 / 3) < 1e-9
    assert all(len(t) <= m.SAMPLE_BLOCKS * m.BLOCK for t, _ in sample)


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(rank) + 0.5


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.97), ("sf0.1", 0.995)])
def test_query_on_held_out(spark, sf, least):
    table = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    labels = {r.doc_id: r.quality for r in table.collect()}
    got = QUERIES["op12_quality"](spark, f"/root/testdata/{sf}").collect()
    assert len(got) == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out and r.doc_id in labels]
    score, label = np.array([r.score for r in test]), np.array([labels[r.doc_id] for r in test])
    assert auc(score, label) >= least
    assert np.mean((score >= 0.5) == label) >= least


def test_fit_needs_both_labels():
    assert fit([], 0.5).fixed == 0.5 and fit([(b"a", 0)], 0.0).fixed == 0.0
