"""Streams built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from newsgrid.functions.dates import local_date
from newsgrid.operators.dedupe import drop_seen, first_per_url
from newsgrid.sources.sinks import write_batch


def file_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def unseen(stream: DataFrame, ts: str = "ts", url: str = "url", late: str = "1 day") -> DataFrame:
    """First row per URL inside the watermark; the full seen table is checked per batch."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


def ingest_batches(stream: DataFrame, build: Callable[[DataFrame, int], dict[str, DataFrame]],
                   paths: dict[str, str], checkpoint: str, once: bool = True,
                   keep: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Each micro-batch through ``build`` into one table per result.

    Every table gets one folder per batch, replaced on retry, which makes the
    writes idempotent.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        for name, rows in build(keep(batch), batch_id).items():
            write_batch(rows, paths[name], batch_id)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def earlier(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What the batches before ``batch_id`` have written to ``path``."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(f"{schema}, batch_id long").parquet(path)
            .filter(F.col("batch_id") < batch_id).drop("batch_id"))


def append_unseen(stream: DataFrame, seen: DataFrame, path: str, checkpoint: str,
                  url: str = "url"):
    """The rows whose URL is neither in ``seen`` nor in an earlier batch, the first of each.

    There is no horizon: a URL that comes back after any time is still known, and
    a late row is as good as another.
    """
    kind = f"{url} {stream.schema[url].dataType.simpleString()}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        known = seen.select(url).unionByName(
            earlier(batch.sparkSession, path, kind, batch_id))
        first = first_per_url(batch, [F.xxhash64(*batch.columns)], url)
        write_batch(drop_seen(first, known, url), path, batch_id)

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_counts(stream: DataFrame, count: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str):
    """The counts of every micro-batch, by ``count``, as a part of the totals.

    Nothing is kept as state and no batch writes more than its own counts; rows
    may come as late as they like.  ``total_counts`` adds the parts up.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(count(batch), path, batch_id)

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def total_counts(spark: SparkSession, path: str, schema: StructType, n: str = "n") -> DataFrame:
    """Sums of what ``append_counts`` has written."""
    parts = spark.read.schema(schema).parquet(path)
    return parts.groupBy(*[c for c in schema.names if c != n]).agg(F.sum(n).alias(n))


def rolling_counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "24 hours",
                   slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key over sliding windows."""
    return (stream.withWatermark(ts, late)
            .groupBy(F.window(ts, size, slide).alias("w"), key)
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    key, "n"))


def daily_timeline(stream: DataFrame, ts: str = "ts", late: str = "1 day",
                   zone: str = "UTC") -> DataFrame:
    """Tumbling days in the site's own zone."""
    local = stream.withWatermark(ts, late).withColumn("_w", F.window(ts, "1 day"))
    if zone != "UTC":
        return (stream.groupBy(local_date(F.col(ts), zone).alias("day"))
                .agg(F.count("*").alias("n")))
    return (local.groupBy("_w").agg(F.count("*").alias("n"))
            .select(F.to_date("_w.start").alias("day"), "n"))


def running_counts(stream: DataFrame, key: str = "incident_id") -> DataFrame:
    """Ever-growing counters, written in update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


class RunMetrics(StreamingQueryListener):
    """Collects observed metrics and late-row drops of every batch."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({
            "batch_id": p.batchId, "input_rows": p.numInputRows,
            "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "observed": {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
