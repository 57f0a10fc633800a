import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from newsgrid.llm.crf import fit, forward_backward, held_out, identify, label_texts, Rows, sample_runs, step_by_step
from newsgrid.llm.queries import QUERIES


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 2])
    scores, transitions = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    _, _, got = forward_backward(scores, lengths, transitions)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(transitions[:, path[0]]).sum() * np.exp(
                sum(scores[at + t, y] for t, y in enumerate(path))
                + sum(transitions[x, y] for x, y in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(got[at:at + n], want)
        at += n


def test_chunks_equal_one_long_scan():
    rng = np.random.default_rng(2)
    scores, transitions = rng.normal(size=(1000, 4)), rng.normal(size=(4, 4))
    _, _, got = forward_backward(scores, np.array([31, 32, 33, 904]), transitions)
    step = np.exp(transitions)
    at = 0
    for n in (31, 32, 33, 904):
        e = np.exp(scores[at:at + n])
        f, b = np.zeros((n, 4)), np.ones((n, 4))
        now = np.full(4, .25)
        for t in range(n):
            now = (now @ step) * e[t]
            now /= now.sum()
            f[t] = now
        for t in range(n - 2, -1, -1):
            b[t] = step @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = f * b
        assert np.allclose(got[at:at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_steps_equal_chunks():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 70, 1, 33, 70])
    scores, transitions = rng.normal(size=(177, 5)), rng.normal(size=(5, 5))
    want = forward_backward(scores, lengths, transitions)
    got = step_by_step(scores, lengths, np.exp(transitions - transitions.max()))
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def test_every_label_is_learned(spark):
    """80 labels: the rarest ones are found, too."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)]
        rows += [(len(rows) + j, " ".join(rng.choice(words, 20)), f"l{i}") for j in range(24 if i < 70 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df, F.lit(True), keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    assert np.mean([r.lang == r.lang_pred and r.score > 0.4 for r in got]) > 0.97
    assert {r.lang_pred for r in got} == {f"l{i}" for i in range(80)}


def test_sample_is_bounded_whatever_the_keys(spark):
    names = ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300)]
    rows = [(None, f"a{w} b", "null") for w in names] + [("k", f"c{w} d", "same") for w in names] \
        + [(w, f"e{w} f", "own") for w in names] + [(None, "g h", "copies")] * 300
    df = spark.createDataFrame(rows, "key string, text string, label string")
    runs = sample_runs(df, F.col("key"), 20)
    got = {label: sum(x == label for x, _ in runs) for label, _ in runs}
    assert got == {"null": 20, "same": 20, "own": 20, "copies": 1}


def test_code_switching():
    words = {"en": "the quick brown fox jumps over this lazy dog while they watch with other things".split(),
             "de": "der schnelle braune fuchs springt über diesen faulen hund während sie schauen mit anderen".split()}
    rng = np.random.default_rng(0)
    runs = [(lang, list(rng.choice(words[lang], 12))) for _ in range(150) for lang in words]
    rows = Rows(fit(runs))
    text = "the lazy dog over they watch der braune hund springt über diesen fuchs"
    assert label_texts(rows, [text])[0][0] in ("de", "en")
    assert label_texts(rows, ["THE FOX!! jumps", "der Hund", "123 !!", "", "der hund der hund the"]) \
        and [x for x, _ in label_texts(rows, ["THE FOX!! jumps", "der Hund", "12 !"])] == ["en", "de", "und"]
    at = [rows[w] for w in text.split()]
    _, _, p = forward_backward(rows.table[at], np.array([13]), rows.model.transitions)
    assert [rows.model.labels[y] for y in p.argmax(axis=1)] == ["en"] * 6 + ["de"] * 7
    assert rows.model.transitions[0, 0] > rows.model.transitions[0, 1]


def test_frames(spark):
    df = spark.createDataFrame(
        [(i, "the word of one" if i % 2 else "das wort von eins", "en" if i % 2 else "de", "s", 1.0)
         for i in range(80)] + [(100, None, "en", "s", 0.0), (101, "", None, "s", 0.0), (102, "?? 7", "de", "s", 0.0),
                                (103, "the " * 50_000, None, None, None), (None, "das", None, None, None)],
        "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify(df, ~held_out(), keep=df.columns)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 85 and (rows[100].lang_pred, rows[101].lang_pred, rows[102].lang_pred) == ("und",) * 3
    assert rows[103].lang_pred == "en" and rows[None].lang_pred == "de" and rows[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = identify(df.withColumn("lang", F.lit(None).cast("string")), ~held_out())
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert identify(df.limit(0), ~held_out()).count() == 0


def test_query_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_language"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test)
    assert right >= 0.97, right
