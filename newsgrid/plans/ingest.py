"""An ingest run: new articles, the incidents among them, and its accounting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.dates import as_instant, instant
from newsgrid.functions.numbers import round_half_even
from newsgrid.functions.text import blank_if_null
from newsgrid.operators.classify import (
    CONFIDENCE_MIN, CONFIDENCE_REVIEW, Scorer, gate_incidents, score_incidents,
)
from newsgrid.operators.dedupe import drop_seen, first_per_url, insert_if_absent, mark_seen
from newsgrid.operators.enrich import enrich_articles
from newsgrid.operators.lexicon import ArticleLexicon, IncidentLexicon
from newsgrid.operators.locate import DEFAULT_HOME, Home, look_up_place, match_place
from newsgrid.operators.moderation import review_reason, routed


def dedupe_and_ingest(batch: DataFrame, store: DataFrame, seen: DataFrame,
                      order: Sequence[Column]) -> DataFrame:
    """Batch rows to store: first of their URL, not seen before, not stored live."""
    fresh = drop_seen(first_per_url(batch, order), seen)
    return insert_if_absent(fresh, store, order)


@dataclass(frozen=True)
class IngestRun:
    """Results of one run, each planned only when asked for."""

    articles: Callable[[], DataFrame]
    incidents: Callable[[], DataFrame]
    seen: Callable[[], DataFrame]
    funnel: Callable[[], DataFrame]


def assess(fresh: DataFrame, articles: ArticleLexicon, incidents: IncidentLexicon,
           scorer: Scorer | None = None, score_all: bool = False) -> DataFrame:
    """Enrich, gate and score fresh articles; adds ``candidate``, ``intel``, ``outcome``.

    Only candidates reach the scorer.
    """
    body = blank_if_null(F.col("content"))
    if "excerpt" in fresh.columns:
        body = F.when(body != "", body).otherwise(blank_if_null(F.col("excerpt")))
    rows = enrich_articles(fresh.withColumn("_body", body), articles)
    if score_all:
        rows = rows.withColumn("candidate", F.lit(True))
    else:
        rows = gate_incidents(rows, incidents, body="_body", column="candidate")
    # The scorer sees a null text where the gate said no.
    gated = (rows.withColumn("_t", F.when(F.col("candidate"), F.col("title")))
             .withColumn("_b", F.when(F.col("candidate"), F.col("_body"))))
    scored = score_incidents(gated, incidents, scorer, title="_t", body="_b")
    accepted = F.col("intel.is_incident") & (F.col("intel.confidence") >= CONFIDENCE_MIN)
    return (scored.withColumn("outcome", F.when(~F.col("candidate"), "prefilter_dropped")
                              .when(accepted, "incident").otherwise("rejected"))
            .drop("_t", "_b", "_body"))


def incident_payload(assessed: DataFrame, gazetteer: Sequence | DataFrame, places: DataFrame | None,
                     as_of, row_id: str = "article_id", stop_words: Sequence[str] = (),
                     home: Home = DEFAULT_HOME,
                     keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Located and review-routed incident rows of the accepted articles.

    Texts are matched first and then left behind; ``keep`` may store the narrow
    rest, which the place lookup reads twice.
    """
    found = assessed.filter(F.col("outcome") == "incident")
    excerpt = blank_if_null(F.col("excerpt")) if "excerpt" in found.columns else F.lit("")
    text = F.concat(blank_if_null(F.col("title")), F.lit(" "), excerpt, F.lit(" "),
                    blank_if_null(F.col("content")))
    hint = F.col("intel.location_hint")
    matched = keep(match_place(found, row_id, text, hint, gazetteer, home).select(
        row_id, "title", "url", "source", "published_at", "intel", "_loc"))
    located = look_up_place(matched, row_id, "_loc", hint, F.col("title"), places, stop_words, home)
    i, p = F.col("intel"), F.col("place")
    reason = review_reason(i["confidence"], F.col("location_fallback"), p["specificity"],
                           p["name"], i["used_fallback"], i["flags"], CONFIDENCE_REVIEW)
    kinds = dict(assessed.dtypes)
    when = F.coalesce(as_instant(F.col("published_at"), kinds["published_at"]), instant(as_of))
    rows = located.select(
        row_id, "title", i["incident_type"].alias("type"), p["lat"].alias("latitude"),
        p["lng"].alias("longitude"), i["severity"].alias("severity"),
        F.lit("unsafe").alias("status"), when.alias("incident_time"),
        p["name"].alias("location_name"), F.col("source").alias("reporter_name"),
        F.col("url").alias("source_url"), (reason != "").alias("needs_review"),
        reason.alias("review_reason"), round_half_even(i["confidence"], 2).alias("confidence"),
        F.substring(i["summary"], 1, 500).alias("ai_summary"),
        F.substring(i["severity_reasoning"], 1, 500).alias("ai_severity_reasoning"),
        i["flags"].alias("ai_flags"), i["model"].alias("ai_model"),
        i["is_followup"].alias("ai_is_followup"), instant(as_of).alias("ai_processed_at"))
    return routed(rows)


def run_ingest(batch: DataFrame, article_store: DataFrame, incident_store: DataFrame,
               seen: DataFrame, articles: ArticleLexicon, incidents: IncidentLexicon,
               gazetteer: Sequence | DataFrame, places: DataFrame | None, as_of, order: Sequence[Column],
               row_id: str = "article_id", scorer: Scorer | None = None,
               score_all: bool = False, stop_words: Sequence[str] = (),
               home: Home = DEFAULT_HOME,
               keep: Callable[[DataFrame], DataFrame] = lambda df: df,
               keep_incidents: Callable[[DataFrame], DataFrame] = lambda df: df) -> IngestRun:
    """The whole run.

    ``keep`` may store the assessed articles once (for example
    ``session.cut_lineage``), since three results read them; ``keep_incidents``
    does the same for the narrow rows of the incidents among them.
    """
    fresh = drop_seen(first_per_url(batch, order), seen)

    @cache
    def assessed() -> DataFrame:
        return keep(assess(fresh, articles, incidents, scorer, score_all))

    def stored() -> DataFrame:
        return insert_if_absent(assessed().drop("candidate", "intel", "outcome"), article_store,
                                order)

    def new_incidents() -> DataFrame:
        found = incident_payload(assessed(), gazetteer, places, as_of, row_id, stop_words, home,
                                 keep_incidents)
        return insert_if_absent(found, incident_store, [F.asc(row_id)],
                                url="source_url", store_url="source_url")

    def funnel() -> DataFrame:
        # Accounting without marking every duplicate: a source's rows minus its fresh ones.
        def n(*values: str) -> Column:
            return F.count_if(F.col("outcome").isin(*values))

        asked = batch.groupBy("source").agg(F.count("*").alias("seen"))
        ended = assessed().groupBy("source").agg(
            F.count("*").alias("_fresh"), n("prefilter_dropped").alias("prefilter_dropped"),
            n("rejected", "incident").alias("scorer_checked"),
            n("rejected").alias("scorer_rejected"), n("incident").alias("incidents"))
        counts = ("prefilter_dropped", "scorer_checked", "scorer_rejected", "incidents")
        return asked.join(ended, "source", "left").select(
            "source", "seen",
            (F.col("seen") - F.coalesce("_fresh", F.lit(0))).alias("already_seen"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])

    def marked() -> DataFrame:
        # What is refused for want of a title or URL was not written.
        written = fresh.filter((F.trim(blank_if_null(F.col("title"))) != "")
                               & (blank_if_null(F.col("url")) != ""))
        return mark_seen(seen, written, as_of)

    return IngestRun(stored, new_incidents, marked, funnel)
