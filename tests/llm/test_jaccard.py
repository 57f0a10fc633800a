import random
from itertools import combinations

import corpus_pipeline
from newsgrid.llm import jaccard
from newsgrid.llm.jaccard import candidate_pairs, not_alone, rarity_index, shingle_lists, unconnected
from newsgrid.llm.jaccard import drop_similar


def shingles(text, words=5):
    plain = (text or "").lower().split()
    return {tuple(plain[i:i + words]) for i in range(max(1, len(plain) - words + 1))}


def plain(docs, words=5, similarity=0.8):
    """Keys that stay, by comparing all pairs; and the number of similar pairs of unequal texts."""
    sets = [shingles(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for i, j in combinations(range(len(docs)), 2):
        if min(len(sets[i]), len(sets[j])) < similarity * max(len(sets[i]), len(sets[j])) - 1e-9:
            continue
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            n += sets[i] != sets[j]
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values()), n


def edited(rng, base, edits):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def kept(df, **more):
    return sorted(r.doc_id for r in drop_similar(df, 5, **more).collect())


def test_edited_copies(spark):
    """Copies around similarity 0.8: all at or over it go, none below; the stage drops the same."""
    rng = random.Random(1)
    docs = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        docs += [" ".join(base), edited(rng, base, 1), edited(rng, base, len(base) // 45),
                 edited(rng, base, len(base) // 20)]
    docs += ["one two", "One  two", "one three", "", " \n"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want, similar = plain(docs)
    assert similar > 80
    assert kept(df) == want
    got = corpus_pipeline.near_copies(spark, df, None)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_large_group_with_fringes(spark):
    """One group of many near copies, whose outer ones are not similar to each other."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    docs = [edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(250)]
    docs += [" ".join(f"x{rng.randrange(90)}" for _ in range(80)) for _ in range(50)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert kept(df) == plain(docs)[0]


def indexed(df, similarity=0.8):
    texts = df.select(jaccard.content_of(df["text"]).alias("content"), "text").dropDuplicates(["content"]).cache()
    near = not_alone(texts, 5, similarity)
    return near, rarity_index(shingle_lists(texts.join(near, "content", "left_semi"), 5), similarity)


def test_common_passage_makes_no_pairs(spark):
    """1,000 texts of 150 words share 100 of them: similarity 0.5, and next to nothing is compared."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(100))
    docs = [(i, " ".join([*(f"w{rng.randrange(10 ** 9)}" for _ in range(25)), passage,
                          *(f"w{rng.randrange(10 ** 9)}" for _ in range(25))])) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, index = indexed(df)
    groups = index.select(index["content"].alias("node"), index["content"].alias("root")).distinct()
    assert candidate_pairs(unconnected(index, groups, 0), 0, 1000, 0.8).count() == 0
    assert len(kept(df)) == 1000


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """Every similar pair survives the first filter and meets in the index, frequent shingles or not."""
    rng = random.Random(5)
    docs = []
    for _ in range(30):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 120))]
        docs += [edited(rng, base, rng.randrange(0, 3)) for _ in range(4)]
    sets = [shingles(t) for t in docs]
    hashes = {t: jaccard.shingle_ids(t.encode(), 5) for t in docs}
    assert all(len(hashes[t]) == len(x) for t, x in zip(docs, sets))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    of = {r.text: r.c for r in df.select("text", jaccard.content_of(df["text"]).alias("c")).collect()}
    want = {(of[a], of[b]) for (a, x), (b, y) in combinations(zip(docs, sets), 2)
            if a != b and len(x & y) >= 0.8 * len(x | y) - 1e-9}
    assert len(want) > 20
    for often, counted in ((8, 1000), (2, 3)):
        monkeypatch.setattr(jaccard, "SEEN_OFTEN", often)
        monkeypatch.setattr(jaccard, "CHUNK_IDS", 2000)
        monkeypatch.setattr(jaccard, "COUNTED", counted)
        near, index = indexed(df)
        assert {x for p in want for x in p} <= {r.content for r in near.collect()}
        groups = index.select(index["content"].alias("node"), index["content"].alias("root")).distinct()
        got = {(r.u, r.v) for r in candidate_pairs(unconnected(index, groups, 0), 0, 10 ** 6, 0.8).collect()}
        assert {tuple(sorted(p)) for p in want} <= got
        assert kept(df) == plain(list(enumerate(docs)))[0]


def test_shingle_ids_tell_sets_apart(monkeypatch):
    same = lambda a, b, n=5: jaccard.shingle_ids(a, n).tolist() == jaccard.shingle_ids(b, n).tolist()
    assert same(b"A b\tc  d e f", b"a b c d e f") and same(b"", b" \n")
    assert not same(b"a b c d e f", b"b a c d e f") and not same(b"a b", b"ab")
    text = " ".join(f"w{i % 700} {'x' * (i % 50)}" for i in range(9000)).encode()
    whole = jaccard.shingle_ids(text, 5)
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr(jaccard, "SLICE_SHINGLES", 100)
    assert jaccard.shingle_ids(text, 5).tolist() == whole.tolist()
    long = b"y" * 20_000
    assert len(jaccard.shingle_ids(b" ".join([long, *b"abcdef".split()] * 3), 2)) == 2
    assert not same(long + b" a", long + b"y a")


def test_edges(spark):
    rows = [(None, "a b"), (7, "a b"), (None, None), (9, None), (3, ""), (5, "p " * 50_000), (5, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in drop_similar(df, 5).collect()) == ["3", "5", "5", "7", "None", "None"]
    assert drop_similar(df.limit(0), 5).count() == 0


def test_recall(spark):
    """All similar pairs of the documents of sf0.01 are in one group."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = sorted((r.doc_id, r.text) for r in table.collect())
    assert kept(table) == plain(docs)[0]
