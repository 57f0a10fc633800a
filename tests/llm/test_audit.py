import random
from collections import Counter
from itertools import permutations

from newsgrid.llm.audit import Ledger, audit, classes, text_checks
from newsgrid.llm.queries import QUERIES


def failing(docs):
    """Failure letters of (key, text, part) rows, by the definition."""
    out = []
    for key, text, _ in docs:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        f = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
        f += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else ""
        f += "D" if set(t) & set("#$%&*|") else ""
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        out.append(f + ("E" if copy else ""))
    return out


def plain(docs, labels):
    """The report, document by document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    out = Counter()
    parts = {p or "" for _, _, p in docs}
    for (key, _, part), fails in zip(docs, failing(docs)):
        part = part or ""
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, "".join(order), step)
                if f in fails:
                    if gone:
                        out[at, "redundant"] += 1
                    else:
                        out[at, "removed"] += 1
                        out[at, "good_lost"] += key in good
                        out[at, "toxic_lost"] += key in toxic
                        out[part, f] += 1
                    gone = True
                out[at, "kept"] += not gone
                out[at, "unique_fails"] += fails == f
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, "".join(o), s, *(out[(p, "".join(o), s), c] for c in names), out[p, f])
                  for p in parts for o in permutations("ABCDE") for s, f in enumerate(o, 1))


def got(df):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
             "toxic_lost", "shapley")
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_fields_do_not_run_over():
    ledger = Ledger("ABCDE")
    n = 2 ** 62
    out = ledger.unpack(n * ledger.integer(0b00011, True, False) + 5 * ledger.integer(0b10000, False, True))
    first = [k for k, o in enumerate(permutations("ABCDE")) if o == tuple("ABCDE")][0] * 5
    assert out["removed"][first:first + 5].tolist() == [n, 0, 0, 0, 5]
    assert out["redundant"][first:first + 5].tolist() == [0, n, 0, 0, 0]
    assert out["kept"][first:first + 5].tolist() == [5, 5, 5, 5, 0]
    assert out["unique_fails"][first:first + 5].tolist() == [0, 0, 0, 0, 5]
    assert out["toxic_lost"][first:first + 5].tolist() == [0, 0, 0, 0, 5]
    assert 4 * ledger.cells == 2400 and len(out["kept"]) == 600


def test_against_each_document(spark):
    rng = random.Random(3)
    pool = ["", None, " \t\n", "a " * 250, "| pipe", "ABC def", " ".join(f"w{i}" for i in range(300)),
            "X" + " ".join(f"w{i}" for i in range(200)) + "\x0b", "é" * 49 + "A", "é" * 48 + "AB", "ÀÉ",
            "#" + " ".join(f"w{i // 2}" for i in range(400)), "long " * 60_000,
            " ".join(f"w{i}" for i in range(199)), " ".join("ab" for _ in range(300))]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(pool), rng.choice(["a", "a", "a", "b", "", None]))
            for i in range(150)]
    docs += [(5, "same", "a"), (5, "same", "b"), (5, "same", "b"), (4, "other", "c"), (-3, "same", "c")]
    rng.shuffle(docs)
    labels = [(rng.randrange(150) if rng.random() < 0.9 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None]))
              for _ in range(100)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs],
                               "doc_id long, text string, source string, fails int, part string").repartition(3)
    of = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert got(audit(df, of)) == plain(docs, labels)
    assert got(audit(df, of.limit(0))) == plain(docs, [])
    assert audit(df.limit(0), of).count() == 0
    masks = Counter(f for f in failing(docs))
    found = Counter()
    for r in classes(df, of, text_checks(df["text"])).collect():
        found["".join("ABCDE"[k] for k in range(5) if r.fails >> k & 1)] += r.n
    # Without audit() a null text has no checks of its own; its mask still counts it as a copy.
    assert sum(found.values()) == sum(masks.values())


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert got(QUERIES["op11_filter_audit"](spark, sf)) == plain(docs, labels)
