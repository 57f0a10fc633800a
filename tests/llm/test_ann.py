import numpy as np
from pyspark.sql import functions as F

from newsgrid.llm import ann, descent
from newsgrid.llm.ann import STILL, descend, nearest_rows
from newsgrid.llm.queries import QUERIES

TYPE = "vec_id long, embedding array<float>, label int, node long, vec string"


def exact(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        order = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:k]
        out[q] = order
    return out


def check(rows, want, least):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, mine in got.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want[q]) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in want[q]})
        total += len(want[q])
    assert hits >= least * total, hits / total


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in table], np.array([r.embedding for r in table], np.float64)
    want = exact(ids, x, [i for i in ids if i % 100 == 0])
    rows = QUERIES["op5_neighbours"](spark, sf).collect()
    check(rows, want, 0.95)
    place = {i: n for n, i in enumerate(ids)}
    for r in rows[:200]:
        gap = x[place[r.vec_id]] - x[place[r.query_id]]
        assert abs(r.score - np.sqrt((gap * gap).sum())) < 1e-12


def test_graph_ends_converged(spark):
    """Vectors without structure: rounds go on until hardly an edge is fresh."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 48)).astype(np.float32)
    nodes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)],
                                  "node long, vec array<float>")
    edges = descend(nodes).collect()
    assert sum(r.fresh for r in edges) <= STILL * len(edges) and STILL <= 0.01


def test_search_looks_at_few_vertices(spark, monkeypatch):
    """A query's share of the table is small, and its neighbours are found nevertheless."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, 5, "x") for i, v in enumerate(x)], TYPE)
    seen, distance = [], ann.distance

    def counted(rows):
        seen.append(rows.count())
        return distance(rows)

    monkeypatch.setattr(ann, "distance", counted)
    got = nearest_rows(df, F.col("id") % 100 == 0).collect()
    check(got, exact(list(range(5000)), x.astype(np.float64), list(range(0, 5000, 100))), 0.95)
    assert sum(seen) <= 0.4 * 5000 * 50, sum(seen)


def test_lists_follow_the_recall(spark, monkeypatch):
    """Over a poor graph short lists find too little; they are doubled."""
    monkeypatch.setattr(ann, "NEIGHBOURS", 6)
    monkeypatch.setattr(ann, "LIST", 12)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, 5, "x") for i, v in enumerate(x)], TYPE)
    got = nearest_rows(df, F.col("id") % 100 == 0).collect()
    check(got, exact(list(range(2000)), x.astype(np.float64), list(range(0, 2000, 100))), 0.95)


def test_copies_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, [float(c) for c in v], 1, 5, "x") for i, v in enumerate(x)]
    bad = [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [1.0] * 7 + [None]),
           (1400, [1.0] * 7 + [float("nan")]), (1500, [1.0] * 7 + [float("inf")]), (1600, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + [rows[0], rows[0]] + [(*b, 1, 5, "x") for b in bad], TYPE)
    got = nearest_rows(df, F.col("id") % 100 == 0).collect()
    want = exact(list(range(400)), x.astype(np.float64), [0, 100, 200, 300])
    check(got, want, 0.95)
    copies = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 200)
    assert [i for _, i in copies] == list(range(100, 110))


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, ""), (1, [2.0, 2.0], 1, 1, ""), (7, [1.0, 2.0], 1, 1, "")], TYPE)
    got = sorted(tuple(r) for r in nearest_rows(df, F.col("id") % 100 == 0).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, 1, 1.0)]
    one = df.filter("vec_id = 0")
    assert nearest_rows(one, F.col("id") % 100 == 0).collect() == []
    assert nearest_rows(df.limit(0), F.col("id") % 100 == 0).collect() == []


def test_graph_is_kept_in_few_rows(spark, monkeypatch):
    """Lists of neighbours are one row a vertex, not one a link, and are right over several rows a part."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    x[:1500] = x[0] + 0.01 * x[:1500]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, 5, "x") for i, v in enumerate(x)], TYPE)
    rows, materialise = {}, ann.materialise

    def counted(df, label):
        out = materialise(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(ann, "materialise", counted)
    got = nearest_rows(df, F.col("id") % 100 == 0).collect()
    check(got, exact(list(range(5000)), x.astype(np.float64), list(range(0, 5000, 100))), 0.95)
    assert rows["graph-links"] <= 5000, rows


def test_graph_lists_are_the_nearest(spark, monkeypatch):
    """Parts of several packed rows; distances in the unit of the vectors, of any size."""
    monkeypatch.setattr(descent, "LEAST_PARTS", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4500, 12)) * 1e20
    x[:40] = x[0] * (1 + 1e-3 * rng.normal(size=(40, 12)))
    nodes = spark.createDataFrame([(i * 7, [float(c) for c in v]) for i, v in enumerate(x)],
                                  "node long, vec array<double>")
    got = {}
    for r in descend(nodes).collect():
        got.setdefault(r.node, {})[r.other] = r.dist
    assert len(got) == 4500 and {len(v) for v in got.values()} == {ann.NEIGHBOURS}
    hits = 0
    for i in range(0, 4500, 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = np.argsort(d)[1:11] * 7
        hits += len(set(near.tolist()) & set(got[i * 7]))
        assert i * 7 not in got[i * 7]
        assert all(abs(v - d[o // 7]) <= 1e-3 * d[o // 7] + 1e14 for o, v in got[i * 7].items())
    assert hits >= 0.97 * 900, hits
