"""The streaming jobs, run over whole tables with ``availableNow``.

Each query streams a table file into a folder below the checkpoint folder and
returns what was written there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from newsgrid.operators import dedupe
from newsgrid.operators.registry import active_sources
from newsgrid.plans.bindings import table, with_views
from newsgrid.plans.catalog_counts import _ISLANDS
from newsgrid.plans.catalog_incidents import REQUESTS, _greedy
from newsgrid.plans.registry import query
from newsgrid.session import RECOMMENDED, checkpoint_dir
from newsgrid.sources.sinks import write_batch
from newsgrid.streaming import flows, stateful

_ROCKS = "spark.sql.streaming.stateStore.providerClass"


def _stream(spark, sf, name):
    """A standard table as a file stream."""
    schema = table(spark, sf, name).schema
    spark.conf.set(_ROCKS, RECOMMENDED[_ROCKS])
    return flows.file_stream(spark, f"{sf}/{name}*.parquet", schema, files_per_trigger=1)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _run(spark, out, mode: str = "append"):
    """Run to the end; every batch is kept."""
    base = _folder(spark)

    def sink(batch, batch_id):
        write_batch(batch, base + "/rows", batch_id)

    (out.writeStream.outputMode(mode).foreachBatch(sink).trigger(availableNow=True)
     .option("checkpointLocation", base + "/state").start().awaitTermination())
    schema = out.schema
    return spark.read.schema(schema).parquet(base + "/rows").select(*schema.names)


def _in_parts(spark, sf, name, parts=3):
    """A standard table as a stream of several micro-batches, each of as many files as the table has splits."""
    folder = _folder(spark) + "/in"
    rows = table(spark, sf, name)
    files = max(1, rows.rdd.getNumPartitions())
    rows.repartition(parts * files).write.parquet(folder)
    return flows.file_stream(spark, folder, rows.schema, files_per_trigger=files)


def _totals(spark, stream, count):
    """Counts of a stream, batch by batch, added up."""
    base = _folder(spark)
    flows.append_counts(stream, count, base + "/parts", base + "/state").awaitTermination()
    return flows.total_counts(spark, base + "/parts", count(stream).schema)


@query("r01_streaming_seen_dedupe", """
SELECT DISTINCT user_id || '-' || event_type AS url FROM events WHERE user_id % 10 <> 0""")
def r01(spark, sf):
    url = F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("url")
    seen = table(spark, sf, "events").filter("user_id % 10 = 0").select(url).distinct()
    base = _folder(spark)
    flows.append_unseen(_in_parts(spark, sf, "events").select("ts", url), seen, base + "/rows",
                        base + "/state").awaitTermination()
    return spark.read.schema("url string").parquet(base + "/rows").select("url")


@query("r02_micro_batch_ingest", """
SELECT 'titled' AS part, count(*) AS n FROM (
  SELECT DISTINCT md5(text) FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '')
UNION ALL SELECT 'rejected', count(*) FROM documents WHERE trim(split_part(text, chr(10), 1)) = ''""")
def r02(spark, sf):
    """Copies of a text are in different batches; each is compared with what is written."""
    base = _folder(spark)
    docs = _in_parts(spark, sf, "documents").select(
        F.col("doc_id").alias("article_id"), F.md5("text").alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    paths = {"titled": base + "/titled", "rejected": base + "/rejected"}

    def build(batch, batch_id):
        stored = flows.earlier(batch.sparkSession, paths["titled"], "url string", batch_id)
        return {"titled": dedupe.insert_if_absent(batch, stored, [F.asc("article_id")]),
                "rejected": dedupe.rejects(batch)}

    flows.ingest_batches(docs, build, paths, base + "/state").awaitTermination()
    parts = [spark.read.schema("article_id long").parquet(paths[p]).agg(F.count("*").alias("n"))
             .select(F.lit(p).alias("part"), "n") for p in paths]
    return parts[0].unionByName(parts[1])


@query("r03_rolling_windows", """
SELECT epoch_us(w) // 1000000 AS window_start_s, event_type, count(*) AS n
FROM (SELECT event_type, ts, unnest(generate_series(
        time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL '18' HOUR,
        time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '2000-01-01'), INTERVAL '6' HOUR)) AS w
      FROM events) GROUP BY 1, 2""")
def r03(spark, sf):
    out = _totals(spark, _in_parts(spark, sf, "events"), lambda batch: flows.rolling_counts(
        batch, "event_type", size="24 hours", slide="6 hours"))
    return out.select(F.unix_seconds("window_start").alias("window_start_s"), "event_type", "n")


@query("r04_daily_timeline_stream", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""")
def r04(spark, sf):
    out = _totals(spark, _in_parts(spark, sf, "events"), flows.daily_timeline)
    return out.select(F.col("day").cast("string").alias("day"), "n")


@query("r09_late_articles", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def r09(spark, sf):
    """The newest rows come first and the oldest last; every late one is counted on its day."""
    folder = _folder(spark) + "/in"
    rows = table(spark, sf, "events")
    rows.withColumn("part", F.when(F.dayofmonth("ts") > 20, 0).when(F.dayofmonth("ts") > 10, 1)
                    .otherwise(2)).write.partitionBy("part").parquet(folder)
    late = flows.file_stream(spark, folder + "/part=*", rows.schema, files_per_trigger=1)
    out = _totals(spark, late, lambda batch: batch.groupBy(
        F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")))
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("r05_streaming_rate_limit", with_views(_greedy("true", 6 * 3600) + """
SELECT event_id, NOT limited AS accepted FROM g""", r=REQUESTS))
def r05(spark, sf):
    out = stateful.limit_rate(_stream(spark, sf, "events"), "user_id", "ts", "event_id", 6 * 3600)
    return _run(spark, out).select("event_id", "accepted")


@query("r06_streaming_ageing", """
WITH k AS (SELECT o_custkey, max(o_orderdate) AS seen_at FROM orders GROUP BY 1),
     wm AS (SELECT max(o_orderdate) - INTERVAL '1' HOUR AS t FROM orders)
SELECT o_custkey AS incident_id, 'active' AS stage, epoch_us(seen_at) // 1000 AS at_ms FROM k
UNION ALL
SELECT o_custkey, s.stage, epoch_us(seen_at) // 1000 + CAST(s.h AS BIGINT) * 3600000
FROM k, (VALUES ('warned', 144), ('expired', 168), ('resolved', 168), ('archived', 720))
  AS s(stage, h), wm
WHERE seen_at + s.h * INTERVAL '1' HOUR <= wm.t""")
def r06(spark, sf):
    out = stateful.age_stream(_stream(spark, sf, "orders"), "o_custkey", "o_orderdate")
    return _run(spark, out)


@query("r07_streaming_breaker", _ISLANDS + """
SELECT label, zero_runs, last_articles FROM (
  SELECT label, CASE WHEN zero_runs = 0 THEN 0 ELSE (zero_runs - 1) % 5 + 1 END AS zero_runs,
         CAST(last_articles AS BIGINT) AS last_articles, run_at, event_id FROM s)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY run_at DESC, event_id DESC) = 1""")
def r07(spark, sf):
    runs = _stream(spark, sf, "events").select(
        F.col("event_type").alias("label"), F.col("ts").alias("run_at"), "event_id",
        F.when(F.col("value") < 30, 0).otherwise(F.floor("value").cast("int"))
        .alias("articles_seen"))
    return _run(spark, stateful.breaker_stream(runs), "update").select(
        "label", "zero_runs", "last_articles")


@query("r08_running_counters", "SELECT l_orderkey AS incident_id, count(*) AS n FROM lineitem GROUP BY 1")
def r08(spark, sf):
    lines = _in_parts(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"))
    return _totals(spark, lines, flows.running_counts)


@query("r10_cadence_selection", """
SELECT doc_id, d.source, CASE WHEN first % 2 = 0 THEN 'fast' ELSE 'slow' END AS cadence
FROM documents d JOIN (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) s ON d.source = s.source
WHERE first % 5 <> 4""")
def r10(spark, sf):
    """One query per cadence: the stream restricted to the registry's enabled sources of that cadence."""
    docs = table(spark, sf, "documents")
    first = F.col("ord")
    listed = docs.groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("ord")).select(
        "id", "ord", (first % 5 != 4).alias("enabled"),
        F.when(first % 2 == 0, "fast").otherwise("slow").alias("cadence"))

    def run(cadence: str) -> DataFrame:
        named = active_sources(listed, cadence).select(F.col("id").alias("source"), "cadence")
        rows = _stream(spark, sf, "documents").select("doc_id", "source").join(named, "source")
        return _run(spark, rows).select("doc_id", "source", "cadence")

    return run("fast").unionByName(run("slow"))


@query("r11_run_metrics", """
SELECT count(*) AS seen, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events""")
def r11(spark, sf):
    """Metrics observed on the way through, appended per batch."""
    base = _folder(spark)
    e = _stream(spark, sf, "events")

    def sink(batch, batch_id):
        from pyspark.sql import Observation
        seen = Observation("run")
        watched = batch.observe(seen, F.count("*").alias("seen"), F.count_if(
            F.col("event_type") == "error").alias("errors"))
        write_batch(watched.select("event_id"), base + "/rows", batch_id)
        row = seen.get
        write_batch(spark.createDataFrame([(row["seen"], row["errors"])],
                                          "seen long, errors long"), base + "/metrics", batch_id)

    (e.writeStream.foreachBatch(sink).trigger(availableNow=True)
     .option("checkpointLocation", base + "/state").start().awaitTermination())
    return spark.read.schema("seen long, errors long").parquet(base + "/metrics").agg(
        F.sum("seen").alias("seen"), F.sum("errors").alias("errors"))


