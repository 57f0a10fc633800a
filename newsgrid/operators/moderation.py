"""Review queues, decisions, edits, scorer metadata patches, update validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.text import address_hash, blank_if_null, first_words, strip_tags
from newsgrid.operators.grouped import keep_first, latest_per_key
from newsgrid.schemas import (
    INCIDENT_TYPES, LIVE_STATUSES, REVIEW_FLAGS, SAFETY_STATUSES, SEVERITIES, UPDATE_SOURCES,
)


# -- review routing -----------------------------------------------------------

def review_reason(confidence: Column, fallback_place: Column, specificity: Column, place: Column,
                  used_fallback: Column, flags: Column, threshold: float = 0.60) -> Column:
    """Reasons in fixed order joined by ``; ``; blank when none applies."""
    # Reason wording shown to reviewers.
    reasons = F.array(
        F.when(confidence < threshold, F.format_string(
            "low classification confidence (%.2f)", confidence)),
        F.when(fallback_place | (specificity <= 1), F.concat(
            F.lit("imprecise location ("), place, F.lit(")"))),
        F.when(used_fallback, F.lit("LLM unavailable — keyword fallback used")),
        F.when(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in REVIEW_FLAGS])),
               F.concat(F.lit("editorial flag: "), F.array_join(flags, ", "))))
    return F.array_join(F.array_compact(reasons), "; ")


def routed(df: DataFrame) -> DataFrame:
    """Status from ``needs_review``; verified unless the caller says otherwise."""
    review = F.coalesce(F.col("needs_review"), F.lit(False))
    given = F.col("is_verified") if "is_verified" in df.columns else F.lit(None).cast("boolean")
    return df.withColumns({"post_status": F.when(review, "pending").otherwise("publish"),
                           "is_verified": F.coalesce(given, ~review)})


def confidence_band(confidence: Column) -> Column:
    return (F.when(confidence >= 0.4, "good").when(confidence >= 0.3, "fair").otherwise("poor"))


# -- queues -------------------------------------------------------------------

def newest_page(df: DataFrame, limit: int, offset: int = 0, date: str = "created_at",
                row_id: str = "incident_id", total: str | None = None) -> DataFrame:
    """Newest first; limit within 1..200, offset not negative.

    ``total`` names a column for the number of rows on all pages.
    """
    limit, offset = max(1, min(200, int(limit))), max(0, int(offset))
    page = df.orderBy(F.desc(date), F.desc(row_id)).offset(offset).limit(limit)
    return page.withColumn(total, df.agg(F.count("*")).scalar()) if total else page


def pending_review(df: DataFrame) -> DataFrame:
    return df.filter((F.col("post_status") == "pending") & F.col("needs_review"))


def review_queue(df: DataFrame, limit: int = 50, **order) -> DataFrame:
    return newest_page(pending_review(df), limit, **order)


def needs_location_fix(df: DataFrame) -> DataFrame:
    return df.filter((F.col("post_status") == "publish") & (
        F.coalesce(F.col("needs_review"), F.lit(False))
        | (F.col("location_precision") == "country")))


def fix_queue(df: DataFrame, page: int = 1, per_page: int = 25, **order) -> DataFrame:
    return newest_page(needs_location_fix(df), per_page, (max(1, page) - 1) * per_page, **order)


def page_count(df: DataFrame, per_page: int = 25) -> DataFrame:
    return df.agg(F.count("*").alias("total"),
                  F.ceil(F.count("*") / F.lit(per_page)).alias("pages"))


def unanalysed(df: DataFrame) -> DataFrame:
    """Live incidents no scorer has looked at."""
    return df.filter(F.col("post_status").isin(*LIVE_STATUSES)
                     & (blank_if_null(F.col("ai_model")) == ""))


def needs_ai(df: DataFrame, limit: int = 50, offset: int = 0, **order) -> DataFrame:
    return newest_page(unanalysed(df), limit, offset, **order)


def recent_analyses(df: DataFrame, limit: int = 15, **order) -> DataFrame:
    done = df.filter((F.col("post_status") == "publish") & (blank_if_null(F.col("ai_model")) != ""))
    return newest_page(done, limit, **order)


def recent_articles(df: DataFrame, source: str | None = None, topic: str | None = None,
                    limit: int = 25, date: str = "published_at",
                    row_id: str = "article_id") -> DataFrame:
    out = df
    if source:
        out = out.filter(F.col("source") == source)
    if topic:
        out = out.filter(F.array_contains("topics", topic))
    return newest_page(out, limit, date=date, row_id=row_id)


# -- decisions and patches ------------------------------------------------------

def latest_decisions(decisions: DataFrame, key: str) -> DataFrame:
    return keep_first(decisions, [key], [F.desc("decided_at"), F.desc("decision_id")])


def moderate(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(decision_id, incident_id, action, reviewer, decided_at)``; the last one holds.

    Approve publishes, verifies and clears the review flag; reject trashes.
    """
    last = latest_decisions(decisions, "incident_id").select(
        "incident_id", "action", "reviewer", "decided_at")
    j = incidents.join(last, "incident_id", "left")
    ok, no = F.col("action") == "approve", F.col("action") == "reject"
    return j.withColumns({
        "post_status": F.when(ok, "publish").when(no, "trash").otherwise(F.col("post_status")),
        "is_verified": F.when(ok, True).otherwise(F.col("is_verified")),
        "needs_review": F.when(ok, False).otherwise(F.col("needs_review")),
        **{c: F.when(ok, F.col(new)).otherwise(F.col(c)) if c in incidents.columns
           else F.when(ok, F.col(new))
           for c, new in (("reviewed_by", "reviewer"), ("reviewed_at", "decided_at"))},
    }).drop("action", "reviewer", "decided_at")


def moderate_updates(updates: DataFrame, decisions: DataFrame) -> DataFrame:
    last = latest_decisions(decisions, "update_id").select("update_id", "action")
    j = updates.join(last, "update_id", "left")
    return j.withColumn("status", F.when(F.col("action") == "approve", "publish")
                        .when(F.col("action") == "reject", "trash")
                        .otherwise(F.col("status"))).drop("action")


def apply_ai(incidents: DataFrame, patches: DataFrame) -> DataFrame:
    """Provided scorer fields overwrite; severity and type only on opt-in.

    Of several patches of one incident the latest by ``ai_processed_at`` holds; a
    null field means "not provided".
    """
    patches = latest_per_key(patches, "incident_id", "ai_processed_at")
    fields = [c for c in ("ai_summary", "ai_severity_reasoning", "ai_flags", "ai_model",
                          "ai_processed_at", "ai_is_followup") if c in patches.columns]
    extra = [c for c in ("severity", "update_severity", "type", "update_type")
             if c in patches.columns]
    p = patches.select(F.col("incident_id"),
                       *[F.col(c).alias("_p_" + c) for c in fields + extra])
    j = incidents.join(p, "incident_id", "left")
    new = {c: F.coalesce(F.col("_p_" + c), F.col(c)) if c in incidents.columns
           else F.col("_p_" + c) for c in fields}
    if {"severity", "update_severity"} <= set(extra):
        new["severity"] = F.when(F.col("_p_update_severity") & F.col("_p_severity").isin(
            *SEVERITIES), F.col("_p_severity")).otherwise(F.col("severity"))
    if {"type", "update_type"} <= set(extra):
        new["type"] = F.when(F.col("_p_update_type") & (blank_if_null(F.col("_p_type")) != ""),
                             F.col("_p_type")).otherwise(F.col("type"))
    return j.withColumns(new).drop(*["_p_" + c for c in fields + extra])


def backfill_outcomes(scored: DataFrame, dry_run: bool = False) -> DataFrame:
    """Add ``outcome`` of a scorer backfill: fallback rows are not written."""
    done = F.lit("skipped" if dry_run else "updated")
    return scored.withColumn("outcome", F.when(F.col("intel.used_fallback"), "fallback")
                             .when(F.col("intel").isNull(), "failed").otherwise(done))


def queue_reanalysis(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Forget the scorer result of the listed incidents."""
    asked = ids.select("incident_id").distinct().withColumn("_again", F.lit(True))
    j = incidents.join(asked, "incident_id", "left")
    again = F.coalesce("_again", F.lit(False))
    new = {"ai_model": F.when(~again, F.col("ai_model")), "needs_reanalysis": again}
    if "ai_processed_at" in incidents.columns:
        new["ai_processed_at"] = F.when(~again, F.col("ai_processed_at"))
    return j.withColumns(new).drop("_again")


# -- edits and updates ----------------------------------------------------------

def whitelisted(value: Column, allowed, default: Column) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def apply_edits(incidents: DataFrame, edits: DataFrame, strict: bool = True) -> DataFrame:
    """``edits(incident_id, type, severity, status, latitude, longitude)``, nulls untouched.

    ``strict`` replaces unknown values by defaults; otherwise they are ignored.
    Out-of-range coordinates keep the old ones either way.  Of several edits of one
    incident the latest by ``edited_at`` holds.
    """
    edits = latest_per_key(edits, "incident_id", "edited_at")
    names = [c for c in ("type", "severity", "status", "latitude", "longitude")
             if c in edits.columns]
    j = incidents.join(edits.select("incident_id", *[F.col(c).alias("_e_" + c) for c in names]),
                       "incident_id", "left")
    rules = {"type": (INCIDENT_TYPES, "fire"), "severity": (SEVERITIES, "low"),
             "status": (SAFETY_STATUSES, "unsafe")}
    new = {}
    for c in names:
        e = F.col("_e_" + c)
        if c in rules:
            allowed, default = rules[c]
            fix = F.lit(default) if strict else F.col(c)
            new[c] = F.when(e.isNotNull(), whitelisted(e, allowed, fix)).otherwise(F.col(c))
        else:
            edge = 90.0 if c == "latitude" else 180.0
            new[c] = F.when(e.between(-edge, edge), e).otherwise(F.col(c))
    return j.withColumns(new).drop(*["_e_" + c for c in names])


def validate_updates(df: DataFrame, max_chars: int = 2000, salt: str = "") -> DataFrame:
    """Submitted follow-ups as stored rows; empty bodies are dropped.

    ``df(incident_id, body, title?, source?, reporter?, severity_hint?, auto_approve?, address?)``
    """
    def given(name: str, default=None) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    clean = df.withColumn("body", strip_tags(F.col("body"))).filter(F.col("body") != "")
    body = F.substring("body", 1, max_chars)
    asked = given("title").cast("string")
    title = F.when(asked.isNull(), first_words(body, 10)).when(asked == "", "Update").otherwise(asked)
    return clean.withColumns({
        "title": title,
        "source": whitelisted(given("source").cast("string"), UPDATE_SOURCES, F.lit("community")),
        "status": F.when(F.coalesce(given("auto_approve", False), F.lit(False)), "publish")
        .otherwise("pending"),
        "reporter": blank_if_null(given("reporter").cast("string")),
        "severity_hint": blank_if_null(given("severity_hint").cast("string")),
        "ip_hash": address_hash(given("address").cast("string"), salt),
        "body": body,
    })


def updates_with_parent(updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Update list with its incident title; updates of missing incidents stay."""
    parents = incidents.select("incident_id", F.col("title").alias("incident_title"))
    return updates.join(parents, "incident_id", "left")


def purge(posts: DataFrame, types, force: bool = False, kind: str = "record_type",
          status: str = "post_status") -> DataFrame:
    """Trash (or with ``force`` remove) every record of the listed types."""
    hit = F.col(kind).isin(*types)
    if force:
        return posts.filter(~hit)
    return posts.withColumn(status, F.when(hit, "trash").otherwise(F.col(status)))


# -- read views -----------------------------------------------------------------

def _or(name: str, default) -> Column:
    """Stored value, or the default for null, blank and zero."""
    c = F.col(name)
    return F.coalesce(c, F.lit(default))


def incident_view(df: DataFrame) -> DataFrame:
    """Fifteen public incident fields with their read-time defaults."""
    def text(name, default):
        return F.when(blank_if_null(F.col(name)) != "", F.col(name)).otherwise(F.lit(default))
    return df.select(
        "incident_id",
        text("type", "fire").alias("type"), _or("latitude", 0.0).alias("latitude"),
        _or("longitude", 0.0).alias("longitude"), text("severity", "low").alias("severity"),
        text("status", "unsafe").alias("status"), "incident_time",
        text("video_url", None).alias("video_url"),
        text("reporter_name", None).alias("reporter_name"),
        _or("is_anonymous", False).alias("is_anonymous"),
        _or("is_verified", True).alias("is_verified"),
        _or("corroboration_count", 0).alias("corroboration_count"),
        text("location_name", None).alias("location_name"),
        text("lifecycle", "active").alias("lifecycle"), "last_update_at",
        _or("update_count", 0).alias("update_count"))


def article_view(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.withColumns({
        "bias_score": _or("bias_score", 0),
        "sentiment": F.when(blank_if_null(F.col("sentiment")) != "", F.col("sentiment"))
        .otherwise("neutral"),
        "sentiment_score": _or("sentiment_score", 0.0),
        "tier": F.when(F.coalesce("tier", F.lit(0)) != 0, F.col("tier")).otherwise(3),
        "topics": F.coalesce("topics", none), "keywords": F.coalesce("keywords", none)})


def social_view(df: DataFrame) -> DataFrame:
    def text(name):
        return F.when(blank_if_null(F.col(name)) != "", F.col(name))
    return df.withColumns({
        "platform": text("platform"), "author_handle": text("author_handle"),
        "post_url": text("post_url"), "engagement": _or("engagement", 0)})

