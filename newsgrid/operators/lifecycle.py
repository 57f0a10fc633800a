"""Incident ageing, expiry, follow-up application and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.dates import as_instant, instant, plus_hours
from newsgrid.schemas import LIFECYCLES

RESOLVE_DAYS, ARCHIVE_DAYS = 7, 30
EXPIRY_DAYS, WARN_HOURS = 7, 24


def stage(df: DataFrame | None = None) -> Column:
    """Lifecycle with its default: unset means active."""
    return F.coalesce(F.col("lifecycle"), F.lit("active"))


def last_activity(df: DataFrame) -> Column:
    """First usable of last_update_at, incident_time and modified_at."""
    kinds = dict(df.dtypes)
    return F.coalesce(*[as_instant(F.col(c), kinds[c])
                        for c in ("last_update_at", "incident_time", "modified_at") if c in kinds])


def age_incidents(df: DataFrame, as_of, resolve_days: int = RESOLVE_DAYS,
                  archive_days: int = ARCHIVE_DAYS) -> DataFrame:
    """Published incidents by silence: active to resolved, then to archived.

    Adds ``resolved_now`` and ``archived_now``; an old active incident passes
    through both in one run.  Developing ones are pinned.
    """
    published = F.col("post_status") == "publish"
    last = F.coalesce(last_activity(df), F.lit(0).cast("timestamp"))
    now = instant(as_of)
    resolves = published & (stage() == "active") & (last < plus_hours(now, -24 * resolve_days))
    after = F.when(resolves, "resolved").otherwise(stage())
    archives = (published & after.isin("resolved", "active")
                & (last < plus_hours(now, -24 * archive_days)))
    return df.withColumns({
        "resolved_now": resolves, "archived_now": archives,
        "lifecycle": F.when(archives, "archived").otherwise(after)})


def sweep_counts(aged: DataFrame) -> DataFrame:
    return aged.agg(F.count_if("resolved_now").alias("resolved"),
                    F.count_if("archived_now").alias("archived"))


def expire_incidents(df: DataFrame, as_of, warn_hours: int = WARN_HOURS) -> DataFrame:
    """Past ``expires_at`` to trash, close to it flagged once; adds ``expired_now``, ``warned_now``."""
    now = instant(as_of)
    eligible = (F.col("post_status") == "publish") & (stage() != "developing")
    warned = F.coalesce(F.col("expiry_warned"), F.lit(False))
    expires = F.coalesce(eligible & (F.col("expires_at") < now), F.lit(False))
    warns = F.coalesce(
        eligible & F.col("expires_at").between(now, plus_hours(now, warn_hours)) & ~warned,
        F.lit(False))
    return df.withColumns({
        "expired_now": expires, "warned_now": warns,
        "post_status": F.when(expires, "trash").otherwise(F.col("post_status")),
        "expiry_warned": warned | warns})


def expiring_soon(df: DataFrame, as_of, hours: int = WARN_HOURS,
                  limit: int | None = None) -> DataFrame:
    """Published incidents expiring from a day ago to ``hours`` ahead, soonest first."""
    now = instant(as_of)
    hit = df.filter((F.col("post_status") == "publish") & (stage() != "developing")
                    & F.col("expires_at").between(plus_hours(now, -24), plus_hours(now, hours)))
    ordered = hit.orderBy(F.asc("expires_at"), F.asc("incident_id"))
    return ordered if limit is None else ordered.limit(limit)


def _refreshed(count: Column, last: Column, as_of) -> dict[str, Column]:
    now = last
    return {
        "update_count": F.coalesce(F.col("update_count"), F.lit(0)) + count,
        "last_update_at": now,
        "lifecycle": F.lit("active"),
        "expires_at": plus_hours(now, 24 * EXPIRY_DAYS),
        "expiry_warned": F.lit(False),
    }


def apply_updates(incidents: DataFrame, updates: DataFrame, as_of=None) -> DataFrame:
    """Approved follow-ups bump their incident, make it active and restart its expiry.

    Every approved update counts exactly once.  The refresh time is ``as_of``, or
    the newest approved update when none is given.
    """
    bumps = (updates.filter(F.col("status") == "publish").groupBy("incident_id")
             .agg(F.count("*").alias("_n"), F.max("created_at").alias("_at")))
    joined = incidents.join(bumps, "incident_id", "left")
    at = F.col("_at") if as_of is None else F.when(F.col("_n").isNotNull(), instant(as_of))
    touched = F.col("_n").isNotNull()
    new = _refreshed(F.coalesce(F.col("_n"), F.lit(0)).cast("int"), at, as_of)
    for name in ("last_update_at", "lifecycle", "expires_at", "expiry_warned"):
        old = F.col(name) if name in incidents.columns else F.lit(None)
        new[name] = F.when(touched, new[name]).otherwise(old)
    return joined.withColumns(new).drop("_n", "_at")


def extend_lifetime(incidents: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Restart the clock of the listed incidents without a new body."""
    asked = ids.select("incident_id").distinct().withColumns(
        {"status": F.lit("publish"), "created_at": instant(as_of)})
    return apply_updates(incidents, asked, as_of)


def touch_on_save(incidents: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(incident_id, edited_at, is_update)``: bookkeeping of saves.

    The last save sets last_update_at, every update counts, a missing or unknown
    lifecycle becomes active and a missing expiry starts at the first save.
    """
    saves = edits.groupBy("incident_id").agg(
        F.count_if("is_update").alias("_n"), F.max("edited_at").alias("_at"),
        F.min("edited_at").alias("_from"))
    j = incidents.join(saves, "incident_id", "left")
    touched = F.col("_at").isNotNull()
    known = F.col("lifecycle").isin(*LIFECYCLES)
    return j.withColumns({
        "last_update_at": F.when(touched, F.col("_at")).otherwise(F.col("last_update_at")),
        "update_count": (F.coalesce(F.col("update_count"), F.lit(0))
                         + F.coalesce(F.col("_n"), F.lit(0))).cast("int"),
        "lifecycle": F.when(touched & ~F.coalesce(known, F.lit(False)), "active").otherwise(
            F.col("lifecycle")),
        "expires_at": F.when(touched & F.col("expires_at").isNull(),
                             plus_hours(F.col("_from"), 24 * EXPIRY_DAYS)).otherwise(
            F.col("expires_at")),
    }).drop("_n", "_at", "_from")


def visible(df: DataFrame, lifecycle: str | None = None,
            include_archived: bool = False) -> DataFrame:
    """Public list: one stage on request, otherwise everything but archived."""
    if lifecycle in LIFECYCLES:
        return df.filter(stage() == lifecycle)
    return df if include_archived else df.filter(stage() != "archived")


def in_stage(df: DataFrame, lifecycle: str | None) -> DataFrame:
    """Admin tab; an unknown stage filters nothing."""
    return df.filter(stage() == lifecycle) if lifecycle in LIFECYCLES else df


def newest_updates(updates: DataFrame, n: int = 50) -> DataFrame:
    """Newest approved updates of every incident."""
    from newsgrid.operators.grouped import top_per_group
    return top_per_group(updates.filter(F.col("status") == "publish"), ["incident_id"],
                         [F.desc("created_at"), F.desc("update_id")], n)


def incidents_with_updates(incidents: DataFrame, updates: DataFrame, n: int = 25) -> DataFrame:
    """Nested view: every incident with its newest approved updates, newest first."""
    fields = [c for c in ("update_id", "title", "body", "source", "reporter", "created_at")
              if c in updates.columns]
    nested = (newest_updates(updates, n).groupBy("incident_id")
              .agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("updates")))
    none = F.array().cast(nested.schema["updates"].dataType)
    return (incidents.join(nested, "incident_id", "left")
            .withColumn("updates", F.coalesce("updates", none)))


def corroborate(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """One more corroboration per event, published incidents only."""
    counts = events.groupBy("incident_id").agg(F.count("*").cast("int").alias("_n"))
    base = F.coalesce(F.col("corroboration_count"), F.lit(0))
    return (incidents.join(counts, "incident_id", "left")
            .withColumn("corroboration_count", F.when(
                F.col("post_status") == "publish", base + F.coalesce("_n", F.lit(0)))
                .otherwise(base))
            .drop("_n"))
