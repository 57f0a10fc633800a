"""The anchored phrase index against the literal form."""

import random

from pyspark.sql import functions as F

from newsgrid.operators import classify as cl, lexicon as lx


def both(spark, docs, table):
    lexicon = spark.createDataFrame([(c, t) for c, ts in table.items() for t in ts], "category string, term string")
    joined = {(r.doc_id, r.category): r.hits for r in lx.category_hits_join(docs, "doc_id", "text", lexicon).collect()}
    literal = lx.count_by_category(docs.withColumn("text", F.lower("text")), "text", table).collect()
    return joined, {(r.doc_id, c): r["n_" + c] for r in literal for c in table if r["n_" + c]}


def test_shapes_of_terms(spark):
    table = {"open": ["oil spill", "a b", "ab-cd", "l s"], "edges": [" war ", " war", "war ", "-x", "x-", "- "],
             "marks": ["c++", "c#", "'tis", "o'clock", "u.s.", "-", "--", "🔥-", "rock 'n' roll"],
             "inner": ["state of emergency", "in state of", "of"], "quoted": ["a\\e-b", "a\\Eb", "(x)"]}
    texts = ["Soil spillage, oil  spill; oil spill.", "post-war war warfare  war", "x-x-x a b aa bb ab-cdab-cd", "c++ C# 'Tis o'clock u.s.",
             "A state of emergency in state of emergencyof", "-- --- -", "rock 'n' roller 🔥-🔥", "a\\e-b a\\eb (x)", "", "warm wars- w", "WAR", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    joined, literal = both(spark, docs, table)
    assert joined == literal
    assert joined[0, "open"] >= 2 and {c for _, c in joined} == set(table)


def test_random_terms(spark):
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice(["a", "b", "ab", "abcde", "bcdefgh", " ", " ", "-", ", ", "'", "é", "7_"]) for _ in range(n))

    table = {f"c{i}": sorted({text(rng.randint(1, 5)) for _ in range(25)}) for i in range(4)}
    docs = spark.createDataFrame([(i, text(rng.randint(0, 60))) for i in range(150)], "doc_id int, text string")
    joined, literal = both(spark, docs, table)
    assert joined == literal and len(joined) > 300


def test_few_phrases_move_no_text(spark, monkeypatch):
    """Few phrases are counted where the text is read, with the same result as by anchors and a join."""
    terms = [("a", "oil spill"), ("a", "spill"), ("b", "o'clock"), ("b", "l s"), ("c", " ")]
    lexicon = spark.createDataFrame(terms, "category string, term string")
    texts = ["Oil spill oil spills", "five O'Clock o'clocks", "", None, "oil  spill", "fuel spill" * 3]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = []
    for direct in (lx.DIRECT, 0):
        monkeypatch.setattr(lx, "DIRECT", direct)
        hits = lx.category_hits_join(docs, "doc_id", "text", lexicon)
        got = sorted(tuple(r) for r in hits.collect())
        final = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        found.append((got, final.count("Join [")))
    assert found[0][0] == found[1][0] and len(found[0][0]) >= 4
    assert found[0][1] == 1 < found[1][1]


def test_a_large_vocabulary(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    terms = list({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(100_000)})
    lexicon = spark.createDataFrame([(f"c{i % 7}", t) for i, t in enumerate(terms)], "category string, term string")
    texts = [rng.choices(words, k=400) for _ in range(12)]
    for i, t in enumerate(texts):
        t[100:100] = terms[i * 50].split() + terms[i * 50 + 1].split()
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.category): r.hits for r in lx.category_hits_join(docs, "doc_id", "text", lexicon).collect()}
    want = {}
    for d, t in enumerate(texts):
        runs = t.split(" ")
        for i, term in enumerate(terms):
            n = t.count(term) if " " in term else runs.count(term)
            if n:
                want[d, f"c{i % 7}"] = want.get((d, f"c{i % 7}"), 0) + n
    assert got == want


def test_empty_tables_repeated_and_null_keys(spark):
    lexicon = spark.createDataFrame([("a", "x y"), ("a", "x"), ("a", None), ("a", ""), ("b", "y")], "category string, term string")
    docs = spark.createDataFrame([(1, "x y"), (1, "x y x y"), (None, "x y"), (None, None)], "doc_id int, text string")
    got = {(r.doc_id, r.category): r.hits for r in lx.category_hits_join(docs, "doc_id", "text", lexicon).collect()}
    assert got == {(1, "a"): 6, (1, "b"): 3, (None, "a"): 2, (None, "b"): 1}
    assert lx.category_hits_join(docs, "doc_id", "text", lexicon.limit(0)).count() == 0
    assert lx.category_hits_join(docs.limit(0), "doc_id", "text", lexicon).count() == 0


def test_classifier_and_gate_with_a_table(spark):
    lex = lx.IncidentLexicon(
        topics={"fire": ["blaze", "smoke", "wild fire"], "flood": ["water", "burst bank", "smoke"]},
        verbs={"fire": ["burned", "set-a"], "flood": ["drowned"], "none": ["hurt"]}, excluded=["league", "concert"],
        excluded_patterns=[r"\bhails\b"], metaphors=["blaze of glory"], severe=["dead"], moderate=["hurt", "lost"],
        rescue=["dead"], headline=["stampede"], cues=["explained"])
    rng = random.Random(7)
    said = ["Blaze", "smoke", "wild fires", "water", "burst banks", "burned", "set-ablaze", "drowned", "hurt", "lost", "dead",
            "league", "concert", "hails", "blaze of glory", "stampede", "explained", "x", "y", "z", "the", "of"]
    rows = [(i, " ".join(rng.choices(said, k=rng.randint(0, 4))), " ".join(rng.choices(said, k=rng.randint(0, 7))), i % 3)
            for i in range(300)] + [(300, None, "blaze smoke water"), (301, "Water drowned", None), (None, "", "")]
    df = spark.createDataFrame([r if len(r) == 4 else (*r, 0) for r in rows],
                               "id int, title string, content string, term int")
    words = [(kind, c, i, t) for kind, table in (("topic", lex.topics), ("verb", lex.verbs))
             for i, (c, ts) in enumerate(table.items()) for t in ts]
    vocabulary = spark.createDataFrame(words, "kind string, category string, ord int, term string")
    got = cl.classify_incidents_join(df, "id", vocabulary, lex)
    want = cl.classify_incidents(df, lex)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert 20 < got.filter("incident IS NOT NULL").count() < 280
    got, want = cl.gate_incidents_join(df, "id", vocabulary, lex), cl.gate_incidents(df, lex)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert 20 < got.count() < 290
    empty = cl.classify_incidents_join(df, "id", vocabulary.limit(0), lex)
    assert empty.count() == df.count() and empty.filter("incident IS NOT NULL").count() == 0
