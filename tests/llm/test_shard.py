import random
import zlib

from newsgrid.llm.queries import QUERIES
from newsgrid.llm.shard import difference, shard_by_bytes, write_shards


def test_difference_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10_000) for _ in range(3000)]
    sums = [0] * 16
    for size, shard in zip(sizes, difference(sizes, 16)):
        sums[shard] += size
    assert max(sums) - min(sums) < 50
    assert difference([], 4) == [] and difference([7], 3) == [0]
    assert sorted(difference([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_one_group_with_most_bytes(spark):
    rows = [(i, "x" * 500) for i in range(300)] + [(1000 + i, f"text {i} " * 9) for i in range(900)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    hot = {r.shard for r in got if r.size == 501}
    assert len(hot) == 1
    sums = [sum(r["size"] for r in got if r.shard == s) for s in range(4) if s not in hot]
    assert max(sums) - min(sums) < 400


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    by_text = {}
    for r in rows:
        text = docs[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert by_text.setdefault(docs[r.doc_id], r.shard) == r.shard


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_shards"](spark, sf).collect()
    check(rows, docs, 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_edges(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, None, 5), (2, None, 6), (3, "", 7), (4, "é", 8), (4, "é", 8), (None, "é", None)],
        "doc_id long, text string, shard int")
    got = shard_by_bytes(df, 2, keep=df.columns)
    assert got.columns == ["doc_id", "text", "size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 3, 3, 3]
    for s in (0, 1):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard_by_bytes(df.limit(0)).count() == 0
    write_shards(got, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
