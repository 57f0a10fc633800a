import random

import numpy as np
import xxhash

from newsgrid.llm.components import components
from newsgrid.llm.queries import QUERIES
from newsgrid.llm.simhash import allocate, fingerprint, group_near, links, plan_probes


def plain_print(text, words=4):
    import re
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    shingles = ([" ".join(found)] if len(found) < words else
                [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """print -> least print reachable, by comparing all."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    array = np.array(values, np.uint64)
    for v in values:
        for w in array[np.bitwise_count(array ^ np.uint64(v)) <= 4].tolist():
            a, b = find(v), find(w)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def expected(docs):
    prints = {k: plain_print(t or "") for k, t in docs}
    groups = plain_components(prints.values())
    least = {}
    for k, p in prints.items():
        least[groups[p]] = min(k, least.get(groups[p], k))
    return sorted((k, f"{p:016x}", least[groups[p]]) for k, p in prints.items())


def test_fingerprint():
    for text in ("", " \n", "a", "A b\tc", "a b c d", "Ünï ÜNÏ a b c d e", "x " * 3000, "a\x0bb\x1cc d e f"):
        assert fingerprint(text) == plain_print(text), text
    assert fingerprint("w " * 70_000 + "z") == plain_print("w " * 70_000 + "z")


def test_allocation_is_complete_and_least():
    costs = [[0, 5, 9], [0, 1, 100], [0, 7, 8]]
    assert allocate(costs, 1) == (18, [1, 0, 0]) or allocate(costs, 1)[0] == min(
        sum(costs[i][t + 1] for i, t in enumerate(c))
        for c in [(a, b, d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]
        if sum(c) == 1)
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    for n in (1, 500, 10 ** 6, 10 ** 10):
        plan = plan_probes(n, bits.T @ bits * n / 500, 4)
        masks = [m for m, _ in plan]
        assert sum(masks) == sum({*masks}) and all(a & b == 0 for a in masks for b in masks if a != b)


def test_near_group_of_many(spark):
    """A tight group, chains off it, and far ones: the same components as comparing all."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(800):
        x = centre
        for _ in range(rng.choice([1, 1, 2, 2, 3, 3, 4, 4] * 8 + [5, 6])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(600)} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, 9 if q == centre else 1) for p, q in zip(signed, prints)],
                               "print long, n long")
    got = links(df).distinct().collect()
    array = np.array(list(prints), np.uint64)
    close = (np.bitwise_count(array[:, None] ^ array) <= 4).sum() // 2
    assert len(got) < close / 5
    roots = {r.node: r.root for r in components(spark.createDataFrame(got)).collect()}
    want = plain_components(prints)
    back = lambda p: p + (1 << 64) if p < 0 else p
    groups = {}
    for p in signed:
        groups.setdefault(roots.get(p, p), set()).add(want[back(p)])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op1_simhash_groups"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected(docs)


def test_edges(spark):
    docs = [(5, None), (3, ""), (4, " \n "), (9, "one two"), (8, "one two"), (8, "one two"),
            (1, "p " * 100_000), (2, "one two three four five six")]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs],
                               "doc_id long, text string, fingerprint string, print int")
    got = group_near(df).collect()
    want = dict((k, (f, c)) for k, f, c in expected(docs))
    assert len(got) == len(docs)
    assert all((r.fingerprint, r.component_id) == want[r.doc_id] for r in got)
    assert group_near(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a"), (7, "a"), (None, "zz yy")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in group_near(none).collect()) == ["7", "7", "None"]
