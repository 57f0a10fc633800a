import hashlib
import random

import numpy as np

import newsgrid.llm.substrings as S
from newsgrid.llm.queries import QUERIES
from newsgrid.llm.substrings import dedup_substrings, segments
from newsgrid.llm.suffixes import suffix_array


def plain(docs, n=100):
    """Every string of n bytes looked up in a dictionary of first positions."""
    first, out = {}, {}
    for key, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if first.setdefault(hash(raw[i:i + n]), (key, i)) != (key, i):
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out[key] = (bytes(b for b, x in zip(raw, gone) if not x), spans, sum(gone))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    pool = [piece(rng.choice([60, 76, 99, 100, 101, 150, 400])) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else piece(rng.randrange(130)) for _ in range(6)]
        if docs and rng.random() < 0.3:
            old = list(rng.choice(docs)[1])
            if old:
                old[rng.randrange(len(old))] = "X"
            parts = ["".join(old)]
        docs.append((i, "".join(parts)))
    return docs + [(n, "a" * 350), (n + 1, "a" * 120), (n + 2, "ab" * 200), (n + 3, None), (n + 4, ""),
                   (n + 5, "x" * 99), (n + 6, docs[0][1]), (n + 7, pool[3] * 2 + pool[3][:50])]


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(3000):
        t = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(30))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    t = [rng.randrange(4) for _ in range(3000)] * 3
    assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_segments_cover_all_strings():
    raws = [t.encode() for _, t in texts(20, 1) if t]
    sizes = np.array([len(r) for r in raws])
    first, end, anchor, h = segments(b"".join(raws), sizes)
    begin = np.cumsum(sizes) - sizes
    want = [b + i for b, n in zip(begin, sizes) for i in range(n - 99)]
    assert [i for a, b in zip(first, end) for i in range(a, b)] == want
    assert ((anchor >= end - 1) & (anchor + 32 <= first + 100)).all() and len(h) == len(first)


def compare_with_plain(spark, docs):
    df = spark.createDataFrame([(*d, 1, b"") for d in docs],
                               "doc_id long, text string, spans int, kept binary").repartition(5)
    got = {r.doc_id: r for r in dedup_substrings(df).collect()}
    want = plain(docs)
    assert set(got) == set(want)
    for key, (kept, spans, removed) in want.items():
        assert bytes(got[key].kept) == kept, key
        assert len(got[key].spans) == spans
        assert sum(s["end"] - s["first"] for s in got[key].spans) == removed


def test_against_brute_force(spark):
    for seed in (1, 2):
        compare_with_plain(spark, texts(60, seed))


def test_hot_cores(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    compare_with_plain(spark, texts(40, 5))


def test_edges(spark):
    df = spark.createDataFrame([(None, "y" * 300), (1, "y" * 300), (1, "y" * 300), (2, "z" * 200_000)],
                               "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in dedup_substrings(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", 300)]
    assert dedup_substrings(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(docs)
    rows = QUERIES["op2_substring_dedup"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, spans, removed = want[r.doc_id]
        assert (r.n_removed, r.n_spans) == (removed, spans), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert any(r.n_removed for r in rows)
