"""Counts and dashboards: one aggregation each, partial before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.dates import age_seconds, in_window, plus_hours, instant
from newsgrid.functions.numbers import percent
from newsgrid.functions.text import blank_if_null
from newsgrid.operators.lifecycle import stage
from newsgrid.schemas import LIFECYCLES

FRESH_SECONDS, STALE_SECONDS = 7200, 86400


def top_counts(df: DataFrame, key: str, k: int | None, order: str | None = None) -> DataFrame:
    """``key, n``: most frequent first, ties by first appearance in ``order``, then by key."""
    aggs = [F.count("*").alias("n")] + ([F.min(order).alias("_first")] if order else [])
    counted = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")
                        ).groupBy(key).agg(*aggs)
    ties = [F.asc("_first")] if order else []
    out = counted.orderBy(F.desc("n"), *ties, F.asc(key))
    return (out if k is None else out.limit(k)).select(key, "n")


def fixed_counts(df: DataFrame, column: str, values: Sequence, prefix: str) -> DataFrame:
    """One row with a count per listed value, zeros included, other values ignored."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values])


def freshness(age: Column) -> Column:
    return (F.when(age < FRESH_SECONDS, "fresh").when(age < STALE_SECONDS, "stale")
            .otherwise("down"))


def source_health(articles: DataFrame, as_of, window: str = "24h", source: str = "source",
                  ts: str = "published_at", limit: int | None = None) -> DataFrame:
    """Per source: total, count in window, last seen, age and status; most recent first.

    ``limit`` keeps the first so many sources, as on a panel of fixed size.
    """
    inside = in_window(F.col(ts), as_of, window, inclusive=True)
    health = (articles.groupBy(F.col(source).alias("source"))
              .agg(F.count("*").alias("total"), F.count_if(inside).alias("in_window"),
                   F.max(ts).alias("last_seen"))
              .withColumn("age_sec", age_seconds(F.col("last_seen"), as_of))
              .withColumn("status", freshness(F.col("age_sec"))))
    ordered = health.orderBy(F.desc("last_seen"), F.asc("source"))
    return ordered if limit is None else ordered.limit(limit)


def daily_counts(df: DataFrame, ts: str, zone: str = "UTC") -> DataFrame:
    from newsgrid.functions.dates import local_date
    return (df.groupBy(local_date(F.col(ts), zone).alias("day"))
            .agg(F.count("*").alias("n")).orderBy("day"))


def lifecycle_counts(incidents: DataFrame) -> DataFrame:
    staged = incidents.withColumn("lifecycle", stage()).filter(F.col("lifecycle").isin(*LIFECYCLES))
    return staged.groupBy("lifecycle").agg(F.count("*").alias("n"))


def status_counts(updates: DataFrame, statuses: Sequence[str] = ("pending", "publish", "trash"),
                  status: str = "status") -> DataFrame:
    return (updates.filter(F.col(status).isin(*statuses)).groupBy(status)
            .agg(F.count("*").alias("n")))


def type_status_counts(posts: DataFrame, kind: str = "record_type",
                       status: str = "post_status") -> DataFrame:
    """Records per type and status with subtotals; nulls mark the totals."""
    live = posts.filter(F.col(status).isin("publish", "draft", "pending", "trash"))
    return live.rollup(kind, status).agg(F.count("*").alias("n"))


def run_funnel(outcomes: DataFrame, source: str = "source") -> DataFrame:
    """Per source: how many articles ended at which step of an ingest run."""
    def n(value: str) -> Column:
        return F.count_if(F.col("outcome") == value)
    checked = F.count_if(F.col("outcome").isin("rejected", "incident"))
    return outcomes.groupBy(source).agg(
        F.count("*").alias("seen"), n("already_seen").alias("already_seen"),
        n("prefilter_dropped").alias("prefilter_dropped"), checked.alias("scorer_checked"),
        n("rejected").alias("scorer_rejected"), n("incident").alias("incidents"))


def ai_backlog(incidents: DataFrame) -> DataFrame:
    published = F.col("post_status") == "publish"
    done = published & (blank_if_null(F.col("ai_model")) != "")
    return incidents.agg(
        F.count_if(published).alias("total"), F.count_if(done).alias("analysed"),
        F.greatest(F.lit(0), F.count_if(published) - F.count_if(done)).alias("needs_ai"))


def ops_dashboard(incidents: DataFrame, updates: DataFrame, as_of, hours: int = 24,
                  shown: int | None = None) -> DataFrame:
    """One row: queue sizes, expiring incidents and scorer coverage.

    Both tables are reduced to the few flags needed and aggregated together.
    ``shown`` is the largest expiring count a board displays; unset, the count is whole.
    """
    now = instant(as_of)
    published = F.col("post_status") == "publish"
    soon = published & (stage() != "developing") & F.col("expires_at").between(
        plus_hours(now, -24), plus_hours(now, hours))
    left = incidents.select(
        ((F.col("post_status") == "pending") & F.col("needs_review")).alias("review"),
        F.lit(False).alias("update"), soon.alias("expiring"), published.alias("total"),
        (published & (blank_if_null(F.col("ai_model")) != "")).alias("analysed"))
    none = F.lit(False)
    right = updates.filter(F.col("status") == "pending").select(
        none.alias("review"), F.lit(True).alias("update"), none.alias("expiring"),
        none.alias("total"), none.alias("analysed"))
    n = left.unionByName(right).agg(*[
        F.count_if(c).alias(c) for c in ("review", "update", "expiring", "total", "analysed")])
    expiring = F.col("expiring") if shown is None else F.least(F.lit(shown), F.col("expiring"))
    return n.select(
        F.col("review").alias("pending_review"), F.col("update").alias("pending_updates"),
        expiring.alias("expiring"), F.col("total").alias("incidents"),
        percent(F.col("analysed"), F.col("total")).alias("ai_percent"))
