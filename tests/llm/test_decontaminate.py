import random
import re

from newsgrid.llm.decontaminate import drop_contaminated, find_items
from newsgrid.llm.queries import QUERIES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, items, threshold=0.8):
    out = []
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(5, len(w))
        wanted = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for key, doc in docs:
            d = words(doc)
            shared = len(wanted & {tuple(d[i:i + n]) for i in range(len(d) - n + 1)})
            if key is not None and shared >= threshold * len(wanted) - 1e-9:
                out.append((key, item, len(wanted), shared))
    return sorted(out)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op8_benchmark_matches"](spark, sf).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got) == plain(docs, items)
    assert got


def test_parts_of_items_and_edges(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate(
        [1, 2, 3, 4, 5, 6, 9, 10, 11, 20, 40, 80, 200])] + [(50, None), (51, " ,. "), (None, "w1 w2")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 300])))) for i in range(30)]
    for i, (item, text) in enumerate(items[:13]):
        w = text.split()
        filler = rng.choices(vocabulary, k=400)
        docs.append((100 + i, " ".join(filler[:200] + w + filler[200:])))
        cut = int(len(w) * 0.85)
        docs.append((200 + i, " ".join(filler[:100] + w[:cut] + filler[100:])))
        if len(w) > 30:
            w[len(w) // 2] = "changed"
            docs.append((300 + i, ("!!! ".join(w)).upper()))
    docs += [(400, None), (401, ""), (None, items[8][1]), (402, items[9][1]), (402, items[9][1])]
    dirty = spark.createDataFrame([(*d, 1, "x") for d in docs],
                                  "doc_id long, text string, item_id int, words string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = find_items(dirty, tests).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got) == sorted(
        set(plain(docs, items)))
    assert find_items(dirty, tests.limit(0)).count() == find_items(dirty.limit(0), tests).count() == 0
    left = drop_contaminated(dirty, tests)
    bad = {r.doc_id for r in got}
    assert left.columns == dirty.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(
        str(k) for k, _ in docs if k not in bad)


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op8_benchmark_matches"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
