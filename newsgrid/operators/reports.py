"""Citizen reports and community updates: limits first, then validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgrid.functions.numbers import inside
from newsgrid.functions.text import blank_if_null, strip_tags
from newsgrid.operators.locate import DEFAULT_HOME, Home
from newsgrid.operators.moderation import validate_updates
from newsgrid.operators.ratelimit import greedy_accept

REPORT_WINDOW, UPDATE_WINDOW = 600, 300


def accept_reports(requests: DataFrame, window_seconds: int = REPORT_WINDOW,
                   home: Home = DEFAULT_HOME, key: str = "client", ts: str = "ts",
                   event_id: str = "event_id") -> DataFrame:
    """Requests with ``outcome``: accepted, rate_limited or out_of_bounds.

    Only an accepted report uses up the window.
    """
    ok = F.coalesce(inside(F.col("latitude"), F.col("longitude"),
                           *[F.lit(v) for v in home.report_box]), F.lit(False))
    marked = requests.withColumn("_ok", ok)
    decided = greedy_accept(marked, key, ts, event_id, window_seconds, consumes="_ok")
    outcome = (F.when(F.col("limited"), "rate_limited").when(~F.col("_ok"), "out_of_bounds")
               .when(F.col(ts).isNull(), "undated")
               .otherwise("accepted"))
    return (marked.join(decided, event_id).withColumn("outcome", outcome)
            .select(*requests.columns, "outcome"))


def report_incidents(accepted: DataFrame) -> DataFrame:
    """Accepted reports as pending incident rows with their defaults."""
    def given(name: str, default):
        if name not in accepted.columns:
            return F.lit(default)
        return F.when(blank_if_null(F.col(name)) != "", F.col(name)).otherwise(default)
    anonymous = (F.coalesce(F.col("is_anonymous"), F.lit(False))
                 if "is_anonymous" in accepted.columns else F.lit(False))
    return accepted.withColumns({
        "type": given("type", "fire"), "severity": given("severity", "low"),
        "status": F.lit("unsafe"), "post_status": F.lit("pending"),
        "is_anonymous": anonymous, "is_verified": F.lit(False),
        "reporter_name": F.when(anonymous, "").otherwise(given("reporter_name", "")),
        "corroboration_count": F.lit(0)})


def accept_updates(requests: DataFrame, incidents: DataFrame, window_seconds: int = UPDATE_WINDOW,
                   key: str = "client", ts: str = "ts", event_id: str = "event_id",
                   salt: str = "") -> DataFrame:
    """Requests with ``outcome``: accepted, rate_limited, no_incident or empty_body.

    Every request that is not limited uses up the window, valid or not.
    """
    decided = greedy_accept(requests, key, ts, event_id, window_seconds)
    known = incidents.select("incident_id").distinct().withColumn("_known", F.lit(True))
    body = strip_tags(F.col("body"))
    outcome = (F.when(F.col("limited"), "rate_limited").when(F.col("_known").isNull(),
                                                            "no_incident")
               .when(body == "", "empty_body").when(F.col(ts).isNull(), "undated")
               .otherwise("accepted"))
    return (requests.join(decided, event_id).join(known, "incident_id", "left")
            .withColumn("outcome", outcome).select(*requests.columns, "outcome"))


def stored_updates(decided: DataFrame, salt: str = "") -> DataFrame:
    return validate_updates(decided.filter(F.col("outcome") == "accepted"), salt=salt)
