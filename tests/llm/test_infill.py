import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsgrid.llm import infill as m
from newsgrid.llm.infill import fit_pieces, infill, restored, unit_index
from newsgrid.llm.queries import QUERIES


def plain(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, mid, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé漢😀 \n<P>"), max_size=400), st.integers(0, 10 ** 6))
def test_cut_equals_slicing(text, key):
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    got = m.cut(text.encode(), digest)
    assert (*got[:4], got[4].decode()) == plain(key, text)


def test_index_is_exact_and_bounded(monkeypatch):
    """Every rank is found; pieces keep the error; blocks change nothing."""
    rng = np.random.default_rng(0)
    for mix in ([1, 0, 0, 0], [.9, .1, 0, 0], [.5, .2, .2, .1], [0, 0, 0, 1]):
        text = "".join(rng.choice(list("aé漢😀"), 20_000, p=mix))
        text += "😀" * 3000 + "a" * 3000
        want = np.cumsum([0, *(len(c.encode()) for c in text)])
        starts, slopes = fit_pieces(want)
        for a, b, k in zip(starts, [*starts[1:], len(want)], slopes):
            assert np.abs(want[a] + k * np.arange(b - a) - want[a:b]).max() <= m.ERROR + 1e-6
        assert len(starts) < len(want) / 100
        index = unit_index(text.encode())
        assert [index.at(k) for k in range(0, len(want), 7)] == want[::7].tolist()
        monkeypatch.setattr(m, "BLOCK_BYTES", 997)
        index = unit_index(text.encode())
        assert index.n == len(want) and [index.at(k) for k in range(0, len(want), 7)] == want[::7].tolist()
        monkeypatch.undo()


def test_units():
    index = unit_index("  ein zwei\ndrei ".encode(), "words")
    assert [index.at(k) for k in range(index.n)] == [0, 6, 11, 16]
    index = unit_index("a\n\nbé\n".encode(), "lines")
    assert [index.at(k) for k in range(index.n)] == [0, 2, 3, 7]
    assert unit_index(b"", "words").n == unit_index(b"  ", "words").n == 1


def test_frames(spark):
    rows = [(None, "ab cd", "k", "x"), (1, None, "k", "x"), (2, "", "k", "x"), (3, "has <M> in it", "k", "x"),
            (5, "ä" * 3_000_000, "k", "x"), (6, "<" * 40, "k", "x"), (6, "<" * 40, "k", "x"), (7, "S><P", None, None)]
    rows += [(i, f"text {i} mit Wörtern und 漢字", "k", "x") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n string")
    got = infill(df, keep=df.columns)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_units", "middle_units", "output"]
    got = got.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, *r[2:7]) for r in got))) == sorted(
        map(str, ((k, *plain(k, t)) for k, t, *_ in rows)))
    assert all(r.again == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert infill(df.limit(0)).count() == 0
    words = infill(df, units="words", sentinels=("<a|", "<b|", "<c|"), seed=5).withColumn(
        "again", restored(F.col("output"), F.col("form"), ("<a|", "<b|", "<c|")))
    assert sorted(r.again for r in words.collect()) == sorted(t or "" for _, t, *_ in rows)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = QUERIES["op13_infill"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, a, b, out = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
            n, form, a, b, sha(out), sha(docs[r.doc_id] or ""))
