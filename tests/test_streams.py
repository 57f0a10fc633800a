"""Streams against stored tables, late rows, reference tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from newsgrid.functions import arrays
from newsgrid.plans import catalog_streams
from newsgrid.sources import reference, sinks
from newsgrid.streaming import flows, stateful


def batches(spark, folder, *parts, schema="url string, ts timestamp, n int"):
    for i, rows in enumerate(parts):
        (spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p/part={i}"))
    return flows.file_stream(spark, f"{folder}/p/part=*", schema, files_per_trigger=1)


def test_unseen_has_no_horizon(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", None, 1), ("b", None, 1), ("a", None, 2)],
                     [("b", None, 3), ("c", None, 3), ("old", None, 3)], [("a", None, 4), (None, None, 4)])
    seen = spark.createDataFrame([("old",)], "url string")
    flows.append_unseen(stream, seen, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(str(r.url) for r in got.collect()) == ["None", "a", "b", "c"]


def test_counts_add_up_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [("a", None, 1), ("b", None, 1)], [("a", None, 1)], [("a", None, 1)])
    def count(batch):
        return batch.groupBy("url").agg(F.count("*").alias("n"))
    flows.append_counts(stream, count, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = flows.total_counts(spark, f"{tmp_path}/out", count(stream).schema).collect()
    assert {r.url: r.n for r in got} == {"a": 3, "b": 1}


def test_reference_tables(spark):
    g = spark.createDataFrame([("Mill", "1.5", 2), (" ", "2", 3), ("Abbey", None, 1)],
                              "name string, lat string, specificity long")
    rows = reference.gazetteer_table(g).orderBy("ord").collect()
    assert [(r.name, r.lat, r.specificity) for r in rows] == [("Abbey", None, 1), ("Mill", 1.5, 2)]
    c = spark.createDataFrame([("Upper Hill", "b"), ("Upper Hill", "A x")], "c string, s string")
    (r,) = reference.county_table(c, "c", "s").collect()
    assert (r.slug, [tuple(s) for s in r.subs]) == ("upper-hill", [("A x", "a-x"), ("b", "b")])
    assert reference.country_table(c.withColumnRenamed("c", "name")).first().slug == "upper-hill"


def test_reference_tables_feed_snapping(spark):
    """Boxes and centres of read tables are what snapping takes."""
    raw = spark.createDataFrame(
        [("North", "a", "1.0", 0.5, 1.5, 10.0, 11.0, 10.5), ("North", "b", "2.0", 1.5, 2.5, 10.0, 12.0, 11.0),
         ("South", "c", "-5.0", -6.0, -4.0, 10.0, 11.0, 10.5)],
        "county string, sub string, lat string, min_lat double, max_lat double, min_lng double, max_lng double, lng double")
    got = {r.slug: r for r in reference.county_table(raw, "county", "sub").collect()}
    assert (got["north"].lat, got["north"].min_lat, got["north"].max_lat, got["north"].max_lng) == (1.5, 0.5, 2.5, 12.0)
    countries = reference.country_table(raw.withColumnRenamed("sub", "name").drop("county")).collect()
    assert [(r.ord, r.slug, r.min_lat, r.max_lng) for r in countries][0] == (0, "a", 0.5, 11.0)
    same = spark.createDataFrame([("x", i) for i in range(20)], "name string, lat int")
    once = [[(r.ord, r.lat) for r in reference.gazetteer_table(same.orderBy(F.rand(s))).collect()] for s in (1, 2)]
    assert sorted(once[0]) == sorted(once[1])


def test_sinks_are_read_back(spark, tmp_path):
    incidents = spark.createDataFrame([(1, "x", None)], "incident_id int, type string, ai_model string")
    patches = spark.createDataFrame([(1, "m")], "incident_id int, ai_model string")
    path = sinks.patch_ai(incidents, patches, str(tmp_path / "i"), "2")
    assert spark.read.parquet(path).first().ai_model == "m"
    seen = spark.createDataFrame([("a",)], "url string")
    sinks.append_seen(seen, spark.createDataFrame([("a",), ("b",)], "url string"),
                      "2024-01-01 00:00:00", str(tmp_path / "s"))
    assert [r.url for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["b"]
    assert sinks.reset_seen(seen).count() == 0 and sinks.reset_seen(seen).columns == ["url"]


def test_array_helpers(one):
    many = F.array(*[F.lit(x) for x in ("b", "A", "a", "B", "c", "C")])
    assert one(arrays.distinct_ignoring_case(many)) == ["b", "A", "c"]
    assert one(arrays.distinct_ignoring_case(F.array().cast("array<string>"))) == []
    stored = F.create_map(F.lit("k"), F.lit("v"))
    assert one(arrays.merge_defaults(stored, {"k": "d", "l": "e"})) == {"k": "v", "l": "e"}
    assert one(arrays.merge_defaults(F.lit(None).cast("map<string,string>"), {"k": "d"})) == {"k": "d"}


class _Run:
    """A row of a stream that counts how many of its kind are held."""
    held = most = 0

    def __init__(self, ms, tie, seen):
        self.ms, self.tie, self.seen = ms, tie, seen
        _Run.held += 1
        _Run.most = max(_Run.most, _Run.held)

    def __del__(self):
        _Run.held -= 1


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def by_hand(rows, streak, last, threshold, pause):
    until = None
    for ms, _, seen in sorted(rows):
        if seen > 0:
            streak, last, until = 0, seen, None
        else:
            streak = streak % threshold + 1
            until = ms + pause if streak == threshold else None
    return streak, last, until


def test_breaker_holds_no_rows(monkeypatch):
    """A source's rows of a batch are read one by one, in any order, and not kept."""
    rng = random.Random(4)
    monkeypatch.setattr(stateful, "HELD_ROWS", 16)
    breaker = stateful._Breaker(5, 100)
    breaker.state, streak, last = _State(), 0, None
    for share in (0.0, 0.02, 0.5, 0.0, 0.01, 1.0, 0.0):
        rows = [(rng.randrange(300), i, rng.randrange(1, 9) if rng.random() < share else 0) for i in range(500)]
        _Run.most = _Run.held
        (got,) = breaker.handleInputRows(("a",), (_Run(*r) for r in rows), None)
        assert _Run.most <= _Run.held + 2
        streak, last, until = by_hand(rows, streak, last, 5, 100)
        assert (got.zero_runs, got.last_articles, got.disabled_until_ms) == (streak, last, until)


def test_overridden_rows_are_left_out(monkeypatch):
    """Before the shuffle only what is behind a label's last row with articles is left, per label, nulls included."""
    rng = random.Random(6)
    monkeypatch.setattr(stateful, "HELD_ROWS", 64)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10 ** 6), i, int(rng.random() < 0.3)) for i in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows[i:i + 70]), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["label", "ms", "tie", "seen"])
        for i in range(0, 5000, 70)]
    got = [tuple(r.values()) for b in stateful.ending_rows(iter(batches)) for r in b.to_pylist()]
    assert len(got) < 200 and set(got) <= set(rows)
    for label in ("a", "b", None):
        want, left = ([r[1:] for r in x if r[0] == label] for x in (rows, got))
        assert by_hand(left, 3, None, 5, 7) == by_hand(want, 3, None, 5, 7)
    assert list(stateful.ending_rows(iter(batches[:0]))) == []


def test_parts_follow_the_size_of_the_table(spark, sf, tmp_path, monkeypatch):
    """A table of many splits is dealt out to as many tasks for each of the three batches."""
    monkeypatch.setattr(catalog_streams, "_folder", lambda spark: str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        splits = spark.read.parquet(f"{sf}/lineitem.parquet").rdd.getNumPartitions()
        stream = catalog_streams._in_parts(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 3 and len(list(tmp_path.glob("in/*.parquet"))) == 3 * splits
    flows.append_counts(stream, flows.running_counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert len(list(tmp_path.glob("out/batch_id=*"))) == 3
    got = flows.total_counts(spark, f"{tmp_path}/out", flows.running_counts(stream).schema)
    want = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("incident_id")).agg(
        F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
