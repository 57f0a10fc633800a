"""Per-group ordering that survives hot keys.

``row_number() <= k`` lets Spark put a group limit in front of the shuffle, so
each map task sends at most ``k`` rows per key however many a key holds.
Running values over an unbounded group are split into time buckets: every
bucket is scanned on its own and only one summary row per bucket is carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of every group, ranked from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def latest_per_key(df: DataFrame, key: str, when: str) -> DataFrame:
    """One row per ``key``: the latest by ``when`` if there is such a column.

    Ties, and rows of a table without it, are settled by a hash of the whole row.
    """
    order = [F.col(when).desc_nulls_last()] if when in df.columns else []
    return keep_first(df, [key], [*order, F.xxhash64(*df.columns)])


def capped_by_source(items: DataFrame, registry: DataFrame, source: str, order: Sequence[Column],
                     budget: int, cap: str = "max_per_run", ord_col: str = "ord",
                     default_cap: int = 5) -> DataFrame:
    """At most ``cap`` items per source and ``budget`` in all, sources in registry order."""
    caps = registry.select(F.col("id").alias(source),
                           F.coalesce(F.col(cap), F.lit(default_cap)).alias("_cap"),
                           F.col(ord_col).alias("_ord"))
    ranked = top_per_group(items, [source], order, budget, "_n")
    kept = ranked.join(caps, source).filter(F.col("_n") <= F.col("_cap"))
    return (kept.orderBy("_ord", "_n").limit(budget).drop("_cap", "_ord", "_n"))


def zero_streaks(runs: DataFrame, label: str = "label", run_at: str = "run_at",
                 seen: str = "articles_seen", tie: str | None = None,
                 bucket_seconds: int = 86400) -> DataFrame:
    """Length of the run of zero-yield rows ending at each row, and the last good yield.

    Adds ``zero_runs`` (0 on a productive run) and ``last_articles``.  Rows without a
    time or a label are in no streak: they stay, with nulls in both columns.
    """
    order = [F.col(run_at)] + ([F.col(tie)] if tie else [])
    within = Window.partitionBy(label, "_bucket").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (runs
            .withColumn("_bucket", F.floor(F.unix_seconds(run_at) / bucket_seconds))
            # Said once here, so that both uses below share one shuffle.
            .filter(F.col("_bucket").isNotNull() & F.col(label).isNotNull())
            .withColumn("_rn", F.row_number().over(within))
            .withColumn("_ok", F.when(F.col(seen) > 0, F.col("_rn")))
            .withColumn("_last_ok", F.max("_ok").over(upto))
            .withColumn("_last_seen", F.last(
                F.when(F.col(seen) > 0, F.col(seen)), ignorenulls=True).over(upto)))

    whole = Window.partitionBy(label).orderBy("_bucket")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    # One row per (label, bucket); its size is the time span, not the row count.
    carried = (rows.groupBy(label, "_bucket")
               .agg(F.max("_rn").alias("_n"), F.max("_ok").alias("_ok_in"),
                    F.max_by("_last_seen", "_ok").alias("_seen_in"))
               .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("_ok_at", F.col("_base") + F.col("_ok_in"))
               .withColumn("_ok_before", F.max("_ok_at").over(before))
               .withColumn("_seen_before", F.last("_seen_in", ignorenulls=True).over(before))
               .select(label, "_bucket", "_base", "_ok_before", "_seen_before"))

    at = F.col("_base") + F.col("_rn")
    ok_at = F.coalesce(F.col("_base") + F.col("_last_ok"), F.col("_ok_before"), F.lit(0))
    placed = (rows.join(carried, [label, "_bucket"])
              .withColumn("zero_runs", at - ok_at)
              .withColumn("last_articles", F.coalesce("_last_seen", "_seen_before"))
              .select(*runs.columns, "zero_runs", "last_articles"))
    rest = runs.filter(F.col(run_at).isNull() | F.col(label).isNull())
    return placed.unionByName(rest.select(
        *runs.columns, *[F.lit(None).cast(placed.schema[c].dataType).alias(c)
                         for c in ("zero_runs", "last_articles")]))
