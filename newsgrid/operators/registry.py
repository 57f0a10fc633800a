"""Source registries and source health over run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from newsgrid.functions.dates import instant, plus_hours
from newsgrid.operators.grouped import keep_first, zero_streaks

ZERO_RUNS_BEFORE_PAUSE, PAUSE_HOURS = 5, 168


def active_sources(registry: DataFrame, cadence: str | None = None, only_enabled: bool = True,
                   ord_col: str = "ord") -> DataFrame:
    """Enabled sources of a cadence, the first entry of every id."""
    out = registry.filter(F.col("id").isNotNull())
    if only_enabled:
        out = out.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if cadence:
        out = out.filter(F.col("cadence") == cadence)
    return keep_first(out, ["id"], [F.asc(ord_col)])


def active_social_sources(registry: DataFrame, cadence: str | None = None) -> DataFrame:
    """As above, duplicates kept."""
    out = registry.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    return out.filter(F.col("cadence") == cadence) if cadence else out


def source_by_id(registry: DataFrame, source_id: str, ord_col: str = "ord") -> DataFrame:
    return active_sources(registry, only_enabled=False, ord_col=ord_col).filter(
        F.col("id") == source_id)


def only_sources(items: DataFrame, ids: Sequence[str], column: str = "source") -> DataFrame:
    return items.filter(F.col(column).isin(*ids))


def named_first(named: DataFrame, registry: DataFrame) -> DataFrame:
    """Named sources plus the registry entries no named source covers."""
    rest = registry.join(named.select("id"), "id", "left_anti")
    return named.unionByName(rest.select(*registry.columns), allowMissingColumns=True)


def circuit_breaker(runs: DataFrame, as_of, threshold: int = ZERO_RUNS_BEFORE_PAUSE,
                    pause_hours: int = PAUSE_HOURS, tie: str | None = None,
                    bucket_seconds: int = 86400) -> DataFrame:
    """State of every source at ``as_of`` from its run log.

    A streak of ``threshold`` empty runs pauses a source; the pause ends the
    streak, so streaks over a longer log count modulo the threshold.  Runs without a
    time or a source tell nothing about any source.
    """
    now = instant(as_of)
    known = runs.filter((F.col("run_at") <= now) & F.col("label").isNotNull())
    streaks = zero_streaks(known, tie=tie, bucket_seconds=bucket_seconds)
    order = [F.desc("run_at")] + ([F.desc(tie)] if tie else [])
    last = keep_first(streaks, ["label"], order)
    streak = F.when(F.col("zero_runs") > 0,
                    F.pmod(F.col("zero_runs") - 1, F.lit(threshold)) + 1).otherwise(0)
    until = F.when(streak == threshold, plus_hours(F.col("run_at"), pause_hours))
    paused = F.coalesce(until > now, F.lit(False))
    return last.select(
        "label", F.col("run_at").alias("last_run"), "last_articles",
        F.when(~paused & (streak == threshold), 0).otherwise(streak).cast("long")
        .alias("zero_runs"),
        F.when(paused, until).alias("disabled_until"),
        (~paused).alias("should_run"))


def runnable(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources that are not paused."""
    paused = state.filter(~F.col("should_run")).select(F.col("label").alias("id"))
    return sources.join(paused, "id", "left_anti")
