"""Stored tables.

Appends go through Spark's commit protocol, and streaming batches write to a
folder named after their batch, replaced on retry, so a lost executor or a
replayed batch never leaves a row twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrid.functions.dates import instant
from newsgrid.operators.dedupe import insert_if_absent, mark_seen
from newsgrid.operators.moderation import apply_ai, routed, validate_updates


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as its own partition, replaced when the batch is retried."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def replace_version(df: DataFrame, path: str, version: str) -> str:
    """A changed table as a new version next to the one it was read from."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


def article_rows(batch: DataFrame, store: DataFrame, order: Sequence[Column], as_of) -> DataFrame:
    """Articles to append: new by URL, dated by ``published_at`` or the ingest time."""
    fresh = insert_if_absent(batch, store, order)
    now = instant(as_of)
    return (fresh.withColumn("ingested_at", now)
            .withColumn("published_at", F.coalesce(F.col("published_at").cast("timestamp"), now))
            .withColumn("post_date", F.to_date("published_at")))


def append_articles(batch: DataFrame, store: DataFrame, order: Sequence[Column], as_of,
                    path: str) -> None:
    append(article_rows(batch, store, order, as_of), path, ["post_date"])


def incident_rows(batch: DataFrame, store: DataFrame, order: Sequence[Column],
                  url: str = "source_url") -> DataFrame:
    """Incidents to append: new by URL, routed to review or published."""
    return routed(insert_if_absent(batch, store, order, url=url, store_url=url))


def append_social_posts(batch: DataFrame, path: str) -> None:
    """Titled posts, never compared with what is stored."""
    append(batch.filter(F.trim(F.coalesce("title", F.lit(""))) != ""), path)


def append_updates(batch: DataFrame, path: str, salt: str = "") -> None:
    append(validate_updates(batch, salt=salt), path)


def append_seen(seen: DataFrame, written: DataFrame, as_of, path: str) -> None:
    append(mark_seen(seen, written, as_of), path)


def patch_ai(incidents: DataFrame, patches: DataFrame, path: str, version: str) -> str:
    return replace_version(apply_ai(incidents, patches), path, version)


def merge_ai(spark: SparkSession, table: str, patches: DataFrame) -> None:
    """The same patch as a merge, for catalogs whose tables support it."""
    fields = [c for c in patches.columns if c != "incident_id"]
    (patches.alias("p").mergeInto(table, F.expr(f"{table}.incident_id = p.incident_id"))
     .whenMatched().update({c: F.expr(f"coalesce(p.{c}, {table}.{c})") for c in fields}).merge())


def run_metrics(as_of, **counts: Column) -> list[Column]:
    """Columns for a one-row metrics append, or for ``DataFrame.observe``."""
    return [instant(as_of).alias("ts"), *[c.alias(n) for n, c in counts.items()]]


def label_bridge(records: DataFrame, record_id: str, labels: str, kind: str) -> DataFrame:
    """(record, label) rows from a label column holding one name or a list."""
    is_list = records.schema[labels].dataType.typeName() == "array"
    values = F.explode(labels) if is_list else F.col(labels)
    rows = records.select(F.lit(kind).alias("record_type"), F.col(record_id).alias("record_id"),
                          values.alias("label"))
    return rows.filter(F.trim(F.coalesce("label", F.lit(""))) != "").distinct()


def missing_labels(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Labels to seed: those not stored yet."""
    return wanted.select("label").distinct().join(stored.select("label"), "label", "left_anti")


def reset_seen(seen: DataFrame) -> DataFrame:
    """An empty seen set with the same layout."""
    return seen.limit(0)
