"""Incident upkeep: places, ageing, updates, moderation, limits, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import dates, numbers
from newsgrid.functions.text import title_place_candidates
from newsgrid.functions.udfs import candidate_udtf
from newsgrid.operators import lifecycle, locate, moderation, ratelimit, reports
from newsgrid.operators.registry import PAUSE_HOURS
from newsgrid.plans.bindings import (
    ARTICLES, COUNTIES_ROWS, GAZETTEER, INCIDENT_AS_OF, INCIDENTS, PLACES, REQUESTS, RUNS, TITLE_STOPS,
    UPDATES, counties, counties_sql, countries, countries_sql, county_dicts, d_ascii, places,
    plain, small_table, subs_sql, table, values_sql, view, with_views,
)
from newsgrid.plans.catalog_counts import articles, heavy_articles, incidents, updates
from newsgrid.plans.catalog_text import _place_sql
from newsgrid.plans.registry import query

NOW = f"TIMESTAMP '{INCIDENT_AS_OF}'"
HOME_BOX = "latitude BETWEEN -4.72 AND 5.02 AND longitude BETWEEN 33.91 AND 41.91"
_CENTRES = values_sql([(o, s, n, la, ln) for o, n, s, la, ln, _, _ in COUNTIES_ROWS])


# -- places -----------------------------------------------------------------------

def _match_sql(text: str) -> str:
    """Best gazetteer row per article: names as whole words of a cleaned, padded text."""
    padded = (rf"' ' || regexp_replace(regexp_replace(lower({d_ascii(text)}), '[^a-z0-9_ ]', "
              rf"' , ', 'g'), ' ', '  ', 'g') || ' '")
    rows = values_sql([(g["ord"], g["name"], g["name"].lower().replace(" ", "  "), g["lat"],
                        g["lng"], g["specificity"]) for g in GAZETTEER])
    return f"""SELECT article_id, name, lat, lng, specificity FROM (
        SELECT article_id, {padded} AS p FROM a) x, ({rows}) AS g(ord, name, k, lat, lng, specificity)
      WHERE contains(p, ' ' || k || ' ')
      QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY specificity DESC, ord) = 1"""


@query("j08_gazetteer_match", with_views(_match_sql("title || ' ' || content"), a=ARTICLES))
def j08(spark, sf):
    text = F.concat("title", F.lit(" "), "content")
    m = heavy_articles(spark, sf).select("article_id", locate.gazetteer_match(text, GAZETTEER)
                                   .alias("m"))
    return m.filter(F.col("m").isNotNull()).select("article_id", "m.*")


def _gazetteer(spark):
    return small_table(spark, [(x["ord"], x["name"], x["lat"], x["lng"], x["specificity"])
                               for x in GAZETTEER], "ord, name, lat, lng, specificity")


@query("w05_best_location_by_join", with_views(_match_sql("title || ' ' || content"), a=ARTICLES))
def w05(spark, sf):
    a = heavy_articles(spark, sf).select(
        "article_id", F.concat("title", F.lit(" "), "content").alias("text"))
    return locate.gazetteer_match_join(a, "article_id", "text", _gazetteer(spark))


_CAND = f"""
SELECT article_id, unnest(c) AS word, generate_subscripts(c, 1) AS pos
FROM (SELECT article_id, {_place_sql('title')} AS c FROM a)"""


@query("j09_candidate_place_lookup", with_views(f"""
SELECT article_id, word AS name, p.lat, p.lng FROM ({_CAND}) c
JOIN ({values_sql(PLACES)}) AS p(name, lat, lng) ON lower(c.word) = p.name
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos) = 1""", a=ARTICLES))
def j09(spark, sf):
    a = heavy_articles(spark, sf).select("article_id", title_place_candidates(
        F.col("title"), TITLE_STOPS).alias("c"))
    return locate.lookup_candidates(a, "article_id", "c", places(spark))


# Hints with a listed place, a known place behind an opener or a marker, an unknown one, or nothing.
_PLACE_HINT = """CASE article_id % 8 WHEN 1 THEN '' WHEN 2 THEN 'Eriner' WHEN 3 THEN 'near Tion'
  WHEN 4 THEN 'outer rim' WHEN 5 THEN 'junction of retion' WHEN 6 THEN 'by the Nicht' WHEN 7 THEN ' Thon ' END"""
_EXCERPT = "CASE WHEN article_id % 11 = 0 THEN 'Seen from Para' ELSE concat('From ', source) END"
_HINTED = f"SELECT *, {_PLACE_HINT} AS hint, {_EXCERPT} AS excerpt FROM ({ARTICLES})"

_RESOLVED = f"""
SELECT a.article_id, coalesce(m.name, hm.name, hp.name, f.name, 'Kenya') AS name,
       round(coalesce(m.lat, hm.lat, hp.lat, f.lat, 0.0236), 4) AS lat,
       coalesce(m.specificity, hm.specificity, CASE WHEN coalesce(hp.name, f.name) IS NOT NULL THEN 1 END, 0)
         AS specificity,
       coalesce(m.name, hm.name) IS NULL AND coalesce(hp.name, f.name) IS NOT NULL AS location_fallback
FROM a LEFT JOIN ({_match_sql("title || ' ' || excerpt || ' ' || content")}) m
  ON a.article_id = m.article_id
LEFT JOIN ({_match_sql("coalesce(hint, '')")}) hm ON a.article_id = hm.article_id
LEFT JOIN (SELECT article_id, trim(hint) AS name, p.lat FROM a
           JOIN ({values_sql(PLACES)}) AS p(name, lat, lng)
             ON p.name = regexp_replace(lower(trim(a.hint)), '^near |^junction of ', '')) hp
  ON a.article_id = hp.article_id
LEFT JOIN (SELECT article_id, word AS name, p.lat FROM ({_CAND}) c
           JOIN ({values_sql(PLACES)}) AS p(name, lat, lng) ON lower(c.word) = p.name
           QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos) = 1) f
  ON a.article_id = f.article_id"""


def _resolved(spark, sf, gazetteer):
    a = heavy_articles(spark, sf).withColumns({"hint": F.expr(_PLACE_HINT), "excerpt": F.expr(_EXCERPT)})
    text = F.concat_ws(" ", "title", "excerpt", "content")
    out = locate.resolve_location(a, "article_id", text, F.col("hint"), F.col("title"), gazetteer,
                                  places(spark), TITLE_STOPS)
    return out.select("article_id", "place.name", F.round("place.lat", 4).alias("lat"),
                      "place.specificity", "location_fallback")


@query("c13_resolve_location", with_views(_RESOLVED, a=_HINTED))
def c13(spark, sf):
    return _resolved(spark, sf, GAZETTEER)


@query("c13_resolve_location_by_table", with_views(_RESOLVED, a=_HINTED))
def c13_table(spark, sf):
    return _resolved(spark, sf, _gazetteer(spark))


@query("j10_points_in_county_boxes", with_views("""
SELECT i.incident_id, c.slug AS county_slug FROM i JOIN c
  ON i.latitude BETWEEN c.min_lat AND c.max_lat AND i.longitude BETWEEN c.min_lng AND c.max_lng""",
    i=INCIDENTS, c=counties_sql()))
def j10(spark, sf):
    return locate.containing_counties(incidents(spark, sf), counties(spark), "latitude",
                                      "longitude").select("incident_id", "county_slug")


@query("j11_nearest_county", with_views(f"""
SELECT incident_id, slug AS county FROM i, ({_CENTRES}) AS c(ord, slug, name, lat, lng)
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY (latitude - lat) * (latitude - lat)
  + (longitude - lng) * (longitude - lng), ord) = 1""", i=INCIDENTS))
def j11(spark, sf):
    return incidents(spark, sf).select("incident_id", locate.nearest_county(
        F.col("latitude"), F.col("longitude"), county_dicts())["slug"].alias("county"))


@query("m01_squared_distance", with_views("""
SELECT incident_id, round((latitude - 1.5) * (latitude - 1.5) + (longitude - 36.0)
  * (longitude - 36.0), 6) AS d FROM i""", i=INCIDENTS))
def m01(spark, sf):
    return incidents(spark, sf).select("incident_id", F.round(numbers.squared_degrees(
        F.col("latitude"), F.col("longitude"), F.lit(1.5), F.lit(36.0)), 6).alias("d"))


@query("m05_box_around", with_views("""
SELECT incident_id, round(latitude - 0.35, 4) AS min_lat, round(longitude + 0.35, 4) AS max_lng
FROM i""", i=INCIDENTS))
def m05(spark, sf):
    b = numbers.box_around(F.col("latitude"), F.col("longitude"))
    return incidents(spark, sf).select("incident_id", F.round(b["min_lat"], 4).alias("min_lat"),
                                       F.round(b["max_lng"], 4).alias("max_lng"))


# Editors' picks for every incident, known and unknown slugs included.
_PICKS = """
SELECT incident_id, CASE incident_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'west-land' WHEN 2 THEN 'open-land'
         WHEN 3 THEN 'nowhere' ELSE 'kenya' END AS country,
       CASE CAST(cust_id % 6 AS INTEGER) WHEN 0 THEN 'north-reach' WHEN 1 THEN 'east-hollow'
         WHEN 2 THEN 'south-bank' WHEN 3 THEN 'mid-vale' WHEN 4 THEN '' ELSE 'no-county' END AS county,
       CASE WHEN cust_id % 4 = 0 THEN 'upper-hollow' WHEN cust_id % 4 = 1 THEN 'old-bank'
         WHEN cust_id % 4 = 2 THEN 'no-sub' ELSE '' END AS subcounty
FROM ({incidents}) x
"""


def picks_sql() -> str:
    return _PICKS.replace("{incidents}", plain(INCIDENTS))


def picks(spark, sf):
    return view(spark, sf, _PICKS.replace("{incidents}", INCIDENTS))


def _edits(spark, sf):
    return incidents(spark, sf).join(picks(spark, sf), "incident_id")


_SNAP = f"""
SELECT r.*, CASE
    WHEN NOT at_home OR r.county = '' THEN CASE WHEN l.name IS NOT NULL THEN 'country' END
    WHEN k.slug IS NULL THEN NULL
    WHEN subcounty <> '' AND s.slug IS NOT NULL THEN 'subcounty'
    WHEN latitude BETWEEN k.min_lat AND k.max_lat AND longitude BETWEEN k.min_lng AND k.max_lng
      THEN 'exact'
    WHEN k.n_subs = 0 THEN 'county' END AS precision,
  l.name AS l_name, l.lat AS l_lat, l.min_lat IS NULL OR (latitude BETWEEN l.min_lat AND l.max_lat
    AND longitude BETWEEN l.min_lng AND l.max_lng) AS in_country,
  k.name AS k_name, k.lat AS k_lat, k.slug AS k_slug, s.name AS s_name, s.lat AS s_lat
FROM (SELECT i.*, coalesce(nullif(p.country, ''), 'kenya') AS ctry, p.county, p.subcounty,
             coalesce(nullif(p.country, ''), 'kenya') = 'kenya' AS at_home
      FROM i JOIN ({picks_sql()}) p ON i.incident_id = p.incident_id) r
LEFT JOIN ({countries_sql()}) l ON r.ctry = l.slug
LEFT JOIN ({counties_sql()}) k ON r.county = k.slug
LEFT JOIN ({subs_sql()}) s ON s.county = k.slug AND s.slug = r.subcounty"""
_SNAP_LAT = """CASE precision WHEN 'country' THEN CASE WHEN in_country THEN latitude ELSE l_lat END
  WHEN 'subcounty' THEN s_lat WHEN 'exact' THEN latitude WHEN 'county' THEN k_lat END"""
_SNAP_NAME = """CASE precision WHEN 'country' THEN l_name WHEN 'subcounty' THEN s_name || ', ' || k_name
  ELSE k_name END"""


@query("c09_snap_location", with_views(f"""
SELECT incident_id, precision, round({_SNAP_LAT}, 4) AS lat,
       CASE WHEN precision IS NOT NULL THEN {_SNAP_NAME} END AS name,
       CASE precision WHEN 'country' THEN in_country WHEN 'county' THEN false
         WHEN 'exact' THEN true WHEN 'subcounty' THEN true END AS in_bounds
FROM ({_SNAP})""", i=INCIDENTS))
def c09(spark, sf):
    out = locate.snap_location(_edits(spark, sf), counties(spark), countries(spark))
    return out.select("incident_id", "snap.precision", F.round("snap.lat", 4).alias("lat"),
                      "snap.name", "snap.in_bounds")


@query("c10_apply_snap", with_views(f"""
SELECT incident_id, round(coalesce({_SNAP_LAT}, latitude), 4) AS latitude,
       coalesce(precision, location_precision) AS location_precision, ctry AS location_country,
       CASE WHEN precision = 'country' THEN '' WHEN precision IS NOT NULL THEN k_slug
            WHEN county <> '' THEN county END AS location_county,
       CASE WHEN precision IN ('exact', 'subcounty') THEN false ELSE needs_review END AS needs_review
FROM ({_SNAP})""", i=INCIDENTS))
def c10(spark, sf):
    out = locate.apply_snap(locate.snap_location(_edits(spark, sf), counties(spark),
                                                 countries(spark)))
    return out.select("incident_id", F.round("latitude", 4).alias("latitude"),
                      "location_precision", "location_country", "location_county", "needs_review")


@query("j19_location_edit_requests", with_views(f"""
SELECT incident_id, precision FROM ({_SNAP})
WHERE incident_id IN (SELECT DISTINCT incident_id FROM u WHERE status = 'pending')""",
    i=INCIDENTS, u=UPDATES))
def j19(spark, sf):
    asked = updates(spark, sf).filter("status = 'pending'").select("incident_id").distinct()
    requests = picks(spark, sf).join(asked, "incident_id", "left_semi")
    out = locate.fix_requests(requests, incidents(spark, sf), counties(spark), countries(spark))
    return out.select("incident_id", "snap.precision")


@query("j12_slug_lookups", with_views(f"""
SELECT incident_id, k.name AS county_name, s.name AS sub_name FROM ({picks_sql()}) p
JOIN ({counties_sql()}) k ON p.county = k.slug
LEFT JOIN ({subs_sql()}) s ON s.county = k.slug AND s.slug = p.subcounty""", dummy="SELECT 1"))
def j12(spark, sf):
    c = counties(spark).select(F.col("slug").alias("county"), F.col("name").alias("county_name"),
                               "subs")
    sub = F.get(F.filter("subs", lambda s: s["slug"] == F.col("subcounty")), 0)
    return picks(spark, sf).join(c, "county").select(
        "incident_id", "county_name", sub["name"].alias("sub_name"))


_NEAR = f"""SELECT incident_id, slug, name, lat FROM i, ({_CENTRES}) AS c(ord, slug, name, lat, lng)
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY (latitude - lat) * (latitude - lat)
  + (longitude - lng) * (longitude - lng), ord) = 1"""


@query("c11_auto_snap_out_of_bounds", with_views(f"""
SELECT i.incident_id, round(CASE WHEN out THEN n.lat ELSE i.latitude END, 4) AS latitude,
       CASE WHEN out THEN 'county' WHEN i.severity = 'high' AND location_precision IS NULL
            THEN 'country' ELSE location_precision END AS location_precision,
       CASE WHEN out THEN n.slug END AS location_county,
       CASE WHEN out THEN true ELSE needs_review END AS needs_review
FROM (SELECT *, severity <> 'high' AND NOT ({HOME_BOX}) AS out FROM i) i
JOIN ({_NEAR}) n ON i.incident_id = n.incident_id""", i=INCIDENTS))
def c11(spark, sf):
    i = incidents(spark, sf).withColumn("location_country", F.when(
        F.col("severity") == "high", "west-land"))
    out = locate.auto_snap_out_of_bounds(i, county_dicts())
    return out.select("incident_id", F.round("latitude", 4).alias("latitude"),
                      "location_precision", "location_county", "needs_review")


_BACK = f"""SELECT i.*, n.slug, n.lat AS n_lat, CASE WHEN NOT ({HOME_BOX}) THEN 'snapped'
    WHEN location_precision IS NULL THEN 'labelled' ELSE 'ok' END AS backfill
  FROM i JOIN ({_NEAR}) n ON i.incident_id = n.incident_id"""


@query("c12_backfill_locations", with_views(f"""
SELECT incident_id, backfill, CASE WHEN backfill <> 'ok' THEN slug END AS location_county,
       CASE backfill WHEN 'snapped' THEN 'county' WHEN 'labelled' THEN 'exact'
         ELSE location_precision END AS location_precision
FROM ({_BACK})""", i=INCIDENTS))
def c12(spark, sf):
    i = incidents(spark, sf).withColumn("location_county", F.lit(None).cast("string"))
    return locate.backfill_locations(i, county_dicts()).select(
        "incident_id", "backfill", "location_county", "location_precision")


@query("c12_backfill_counts", with_views(f"""
SELECT count(*) AS scanned, count(*) FILTER (WHERE backfill = 'snapped') AS snapped,
       count(*) FILTER (WHERE backfill = 'snapped') AS flagged,
       count(*) FILTER (WHERE backfill = 'labelled') AS labelled FROM ({_BACK})""", i=INCIDENTS))
def c12_counts(spark, sf):
    return locate.backfill_counts(locate.backfill_locations(
        incidents(spark, sf), county_dicts(), dry_run=True))


# -- ageing and expiry ----------------------------------------------------------------

_LAST = "coalesce(last_update_at, incident_time, modified_at)"


@query("dt05_last_activity", with_views(f"""
SELECT incident_id, epoch_us({_LAST}) AS last_us FROM i""", i=INCIDENTS))
def dt05(spark, sf):
    i = incidents(spark, sf)
    return i.select("incident_id", F.unix_micros(lifecycle.last_activity(i)).alias("last_us"))


@query("c18_age_incidents", with_views(f"""
SELECT incident_id, CASE
    WHEN post_status = 'publish' AND st IN ('active', 'resolved') AND last < {NOW} - INTERVAL '30' DAY
      THEN 'archived'
    WHEN post_status = 'publish' AND st = 'active' AND last < {NOW} - INTERVAL '7' DAY THEN 'resolved'
    ELSE st END AS lifecycle,
  post_status = 'publish' AND st = 'active' AND last < {NOW} - INTERVAL '7' DAY AS resolved_now,
  post_status = 'publish' AND st IN ('active', 'resolved') AND last < {NOW} - INTERVAL '30' DAY
    AS archived_now
FROM (SELECT *, coalesce(lifecycle, 'active') AS st, {_LAST} AS last FROM i)""", i=INCIDENTS))
def c18(spark, sf):
    return lifecycle.age_incidents(incidents(spark, sf), INCIDENT_AS_OF).select(
        "incident_id", "lifecycle", "resolved_now", "archived_now")


@query("c19_expire_incidents", with_views(f"""
SELECT incident_id, CASE WHEN gone THEN 'trash' ELSE post_status END AS post_status,
       gone AS expired_now, expiry_warned OR warn AS expiry_warned, warn AS warned_now
FROM (SELECT *, post_status = 'publish' AND coalesce(lifecycle, 'active') <> 'developing'
               AND expires_at < {NOW} AS gone,
             post_status = 'publish' AND coalesce(lifecycle, 'active') <> 'developing'
               AND expires_at BETWEEN {NOW} AND {NOW} + INTERVAL '24' HOUR AND NOT expiry_warned
               AS warn FROM i)""", i=INCIDENTS))
def c19(spark, sf):
    return lifecycle.expire_incidents(incidents(spark, sf), INCIDENT_AS_OF).select(
        "incident_id", "post_status", "expired_now", "expiry_warned", "warned_now")


_BUMPS = """SELECT incident_id, count(*) AS n, max(created_at) AS seen_at FROM u WHERE status = 'publish'
GROUP BY incident_id"""


@query("c20_apply_updates", with_views(f"""
SELECT i.incident_id, CAST(update_count + coalesce(n, 0) AS INTEGER) AS update_count,
       epoch_us(CASE WHEN n IS NULL THEN last_update_at ELSE seen_at END) AS last_us,
       CASE WHEN n IS NULL THEN lifecycle ELSE 'active' END AS lifecycle,
       epoch_us(CASE WHEN n IS NULL THEN expires_at ELSE seen_at + INTERVAL '7' DAY END) AS expires_us,
       CASE WHEN n IS NULL THEN expiry_warned ELSE false END AS expiry_warned
FROM i LEFT JOIN ({_BUMPS}) b ON i.incident_id = b.incident_id""", i=INCIDENTS, u=UPDATES))
def c20(spark, sf):
    out = lifecycle.apply_updates(incidents(spark, sf), updates(spark, sf))
    return out.select("incident_id", "update_count", F.unix_micros("last_update_at")
                      .alias("last_us"), "lifecycle", F.unix_micros("expires_at")
                      .alias("expires_us"), "expiry_warned")


@query("j17_update_bumps", with_views(_BUMPS.replace("max(created_at) AS seen_at",
                                                    "epoch_us(max(created_at)) AS at_us"),
                                      u=UPDATES), longs=True)
def j17(spark, sf):
    none = updates(spark, sf).select("incident_id").distinct().withColumns({
        "update_count": F.lit(0), "last_update_at": F.lit(None).cast("timestamp"),
        "lifecycle": F.lit("developing"), "expires_at": F.lit(None).cast("timestamp"),
        "expiry_warned": F.lit(True)})
    out = lifecycle.apply_updates(none, updates(spark, sf)).filter("lifecycle = 'active'")
    return out.select("incident_id", F.col("update_count").alias("n"),
                      F.unix_micros("last_update_at").alias("at_us"))


@query("c20_extend_lifetime", with_views(f"""
SELECT i.incident_id, CASE WHEN e.incident_id IS NULL THEN lifecycle ELSE 'active' END AS lifecycle,
       epoch_us(CASE WHEN e.incident_id IS NULL THEN expires_at ELSE {NOW} + INTERVAL '7' DAY END)
         AS expires_us
FROM i LEFT JOIN (SELECT DISTINCT incident_id FROM u WHERE status = 'trash') e
  ON i.incident_id = e.incident_id""", i=INCIDENTS, u=UPDATES))
def c20_extend(spark, sf):
    ids = updates(spark, sf).filter("status = 'trash'")
    out = lifecycle.extend_lifetime(incidents(spark, sf), ids, INCIDENT_AS_OF)
    return out.select("incident_id", "lifecycle", F.unix_micros("expires_at").alias("expires_us"))


@query("c21_touch_on_save", with_views("""
SELECT i.incident_id, CAST(update_count + coalesce(n, 0) AS INTEGER) AS update_count,
       epoch_us(CASE WHEN seen_at IS NULL THEN last_update_at ELSE seen_at END) AS last_us,
       CASE WHEN seen_at IS NOT NULL AND lifecycle IS NULL THEN 'active' ELSE lifecycle END AS lifecycle
FROM i LEFT JOIN (SELECT incident_id, count(*) FILTER (WHERE status <> 'trash') AS n,
                         max(created_at) AS seen_at FROM u GROUP BY incident_id) e
  ON i.incident_id = e.incident_id""", i=INCIDENTS, u=UPDATES))
def c21(spark, sf):
    edits = updates(spark, sf).select("incident_id", F.col("created_at").alias("edited_at"),
                                      (F.col("status") != "trash").alias("is_update"))
    return lifecycle.touch_on_save(incidents(spark, sf), edits).select(
        "incident_id", "update_count", F.unix_micros("last_update_at").alias("last_us"),
        "lifecycle")


@query("p06_predicate_algebra", with_views(f"""
SELECT incident_id FROM i WHERE post_status = 'publish' AND ((expires_at BETWEEN {NOW} - INTERVAL '30' DAY
  AND {NOW} AND coalesce(lifecycle, '') <> 'developing') OR (ai_model IS NULL AND type LIKE '%HIGH%'))""",
    i=INCIDENTS))
def p06(spark, sf):
    now = dates.instant(INCIDENT_AS_OF)
    c = F.col
    return incidents(spark, sf).filter((c("post_status") == "publish") & (
        (c("expires_at").between(dates.plus_hours(now, -720), now)
         & (F.coalesce(c("lifecycle"), F.lit("")) != "developing"))
        | (c("ai_model").isNull() & c("type").contains("HIGH")))).select("incident_id")


@query("p08_lifecycle_visibility", with_views("""
SELECT 'default' AS view, incident_id FROM i WHERE coalesce(lifecycle, 'active') <> 'archived'
UNION ALL SELECT 'resolved', incident_id FROM i WHERE lifecycle = 'resolved'
UNION ALL SELECT 'all', incident_id FROM i""", i=INCIDENTS))
def p08(spark, sf):
    i = incidents(spark, sf)
    parts = [("default", lifecycle.visible(i)), ("resolved", lifecycle.visible(i, "resolved")),
             ("all", lifecycle.visible(i, include_archived=True))]
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("view"), "incident_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("p09_admin_stage_tab", with_views("""
SELECT incident_id FROM i WHERE lifecycle = 'developing'""", i=INCIDENTS))
def p09(spark, sf):
    return lifecycle.in_stage(incidents(spark, sf), "developing").select("incident_id")


@query("p10_review_queue", with_views("""
SELECT incident_id FROM i WHERE post_status = 'pending' AND needs_review
ORDER BY created_at DESC, incident_id DESC LIMIT 50""", i=INCIDENTS))
def p10(spark, sf):
    return moderation.review_queue(incidents(spark, sf)).select("incident_id")


@query("p11_fix_location_queue", with_views("""
SELECT incident_id FROM i WHERE post_status = 'publish' AND (needs_review
  OR location_precision = 'country') ORDER BY created_at DESC, incident_id DESC LIMIT 25 OFFSET 25""",
    i=INCIDENTS))
def p11(spark, sf):
    return moderation.fix_queue(incidents(spark, sf), page=2).select("incident_id")


@query("p13_needs_ai_filter", with_views("""
SELECT incident_id FROM i WHERE coalesce(ai_model, '') = ''""", i=INCIDENTS))
def p13(spark, sf):
    return moderation.unanalysed(incidents(spark, sf)).select("incident_id")


# -- moderation -----------------------------------------------------------------------

@query("j14_corroborate", with_views("""
SELECT i.incident_id, CAST(CASE WHEN post_status = 'publish' THEN corroboration_count + coalesce(n, 0)
  ELSE corroboration_count END AS INTEGER) AS corroboration_count
FROM i LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) e
  ON i.incident_id = e.l_orderkey""", i=INCIDENTS))
def j14(spark, sf):
    events = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"))
    return lifecycle.corroborate(incidents(spark, sf), events).select(
        "incident_id", "corroboration_count")


_DECIDED = """
SELECT incident_id, status, update_id, created_at FROM u
QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, update_id DESC) = 1"""


def _decisions(spark, sf, key="incident_id"):
    u = updates(spark, sf)
    action = (F.when(F.col("status") == "publish", "approve")
              .when(F.col("status") == "trash", "reject").otherwise("wait"))
    return u.select(F.col("update_id").alias("decision_id"), "incident_id", action.alias("action"),
                    F.lit("editor").alias("reviewer"), F.col("created_at").alias("decided_at"))


_MODERATED = f"""
SELECT i.incident_id, CASE d.status WHEN 'publish' THEN 'publish' WHEN 'trash' THEN 'trash'
         ELSE post_status END AS post_status,
       CASE d.status WHEN 'publish' THEN true ELSE is_verified END AS is_verified,
       CASE d.status WHEN 'publish' THEN false ELSE needs_review END AS needs_review,
       epoch_us(CASE d.status WHEN 'publish' THEN d.created_at END) AS reviewed_us
FROM i LEFT JOIN ({_DECIDED}) d ON i.incident_id = d.incident_id"""


@query("c26_moderate", with_views(_MODERATED, i=INCIDENTS, u=UPDATES))
def c26(spark, sf):
    out = moderation.moderate(incidents(spark, sf), _decisions(spark, sf))
    return out.select("incident_id", "post_status", "is_verified", "needs_review",
                      F.unix_micros("reviewed_at").alias("reviewed_us"))


@query("j15_moderate_updates", """
SELECT update_id, CASE action WHEN 'approve' THEN 'publish' WHEN 'reject' THEN 'trash' ELSE status END
  AS status
FROM (SELECT u.*, d.action FROM (SELECT o_orderkey AS update_id, 'pending' AS status FROM orders) u
      LEFT JOIN (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'approve' WHEN 'R' THEN 'reject'
                        ELSE 'wait' END AS action FROM lineitem
                 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC,
                   l_linenumber * 1000000 + l_partkey DESC, l_extendedprice DESC) = 1) d
        ON u.update_id = d.l_orderkey)""")
def j15(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("update_id"),
                                          F.lit("pending").alias("status"))
    action = (F.when(F.col("l_returnflag") == "A", "approve")
              .when(F.col("l_returnflag") == "R", "reject").otherwise("wait"))
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("update_id"), action.alias("action"),
        F.struct(F.col("l_linenumber") * 1000000 + F.col("l_partkey"), "l_extendedprice")
        .alias("decision_id"), F.col("l_shipdate").alias("decided_at"))
    return moderation.moderate_updates(u, d)


@query("j16_apply_ai_patches", with_views("""
SELECT i.incident_id, CASE WHEN p.incident_id IS NULL THEN ai_model ELSE 'm2' END AS ai_model,
       CASE WHEN p.incident_id IS NULL THEN severity WHEN p.n > 3 THEN 'medium' ELSE severity END
         AS severity
FROM i LEFT JOIN (SELECT incident_id, count(*) AS n FROM u GROUP BY 1) p
  ON i.incident_id = p.incident_id""", i=INCIDENTS, u=UPDATES))
def j16(spark, sf):
    patches = updates(spark, sf).groupBy("incident_id").agg(F.count("*").alias("n")).select(
        "incident_id", F.lit("m2").alias("ai_model"), (F.col("n") > 3).alias("update_severity"),
        F.lit("medium").alias("severity"))
    return moderation.apply_ai(incidents(spark, sf), patches).select(
        "incident_id", "ai_model", "severity")


@query("s17_ai_patch_type_opt_in", with_views("""
SELECT i.incident_id, CASE WHEN u.status = 'publish' THEN 'flood' ELSE type END AS type
FROM i LEFT JOIN (SELECT incident_id, max(status) AS status FROM u GROUP BY 1) u
  ON i.incident_id = u.incident_id""", i=INCIDENTS, u=UPDATES))
def s17(spark, sf):
    p = updates(spark, sf).groupBy("incident_id").agg(F.max("status").alias("s")).select(
        "incident_id", (F.col("s") == "publish").alias("update_type"),
        F.lit("flood").alias("type"))
    return moderation.apply_ai(incidents(spark, sf), p).select("incident_id", "type")


@query("c23_needs_ai_page", with_views("""
SELECT incident_id, severity, type, post_status, count(*) OVER () AS total FROM i
WHERE coalesce(ai_model, '') = ''
ORDER BY created_at DESC, incident_id DESC LIMIT 100 OFFSET 200""", i=INCIDENTS))
def c23(spark, sf):
    return moderation.needs_ai(incidents(spark, sf), 100, 200, total="total").select(
        "incident_id", "severity", "type", "post_status", "total")


@query("c23_queue_reanalysis", with_views("""
SELECT i.incident_id, CASE WHEN u.incident_id IS NULL THEN ai_model END AS ai_model,
       u.incident_id IS NOT NULL AS needs_reanalysis
FROM i LEFT JOIN (SELECT DISTINCT incident_id FROM u WHERE status = 'pending') u
  ON i.incident_id = u.incident_id""", i=INCIDENTS, u=UPDATES))
def c23_queue(spark, sf):
    ids = updates(spark, sf).filter("status = 'pending'")
    return moderation.queue_reanalysis(incidents(spark, sf), ids).select(
        "incident_id", "ai_model", "needs_reanalysis")


@query("p17_status_routing", with_views("""
SELECT incident_id, CASE WHEN needs_review THEN 'pending' ELSE 'publish' END AS post_status,
       coalesce(is_verified, NOT needs_review) AS is_verified FROM i""", i=INCIDENTS))
def p17(spark, sf):
    return moderation.routed(incidents(spark, sf)).select("incident_id", "post_status",
                                                          "is_verified")


_EDITS = """SELECT o_orderkey AS incident_id, CASE o_orderstatus WHEN 'F' THEN 'flood'
    WHEN 'O' THEN 'odd' END AS type,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE o_orderpriority END AS severity,
  floor(o_totalprice / 1000) AS latitude FROM {orders}"""


@query("p24_edit_whitelist_strict", with_views("""
SELECT i.incident_id, CASE e.type WHEN 'flood' THEN 'flood' WHEN 'odd' THEN 'fire' ELSE i.type END
         AS type, CASE e.severity WHEN 'high' THEN 'high' ELSE 'low' END AS severity,
       round(CASE WHEN e.latitude BETWEEN -90 AND 90 THEN e.latitude ELSE i.latitude END, 4) AS latitude
FROM i JOIN e ON i.incident_id = e.incident_id""", i=INCIDENTS, e=_EDITS))
def p24(spark, sf):
    out = moderation.apply_edits(incidents(spark, sf), view(spark, sf, _EDITS))
    return out.select("incident_id", "type", "severity", F.round(F.col("latitude").cast("double"), 4)
                      .alias("latitude"))


@query("p24_edit_whitelist_lenient", with_views("""
SELECT i.incident_id, CASE e.type WHEN 'flood' THEN 'flood' ELSE i.type END AS type,
       CASE e.severity WHEN 'high' THEN 'high' ELSE i.severity END AS severity
FROM i JOIN e ON i.incident_id = e.incident_id""", i=INCIDENTS, e=_EDITS))
def p24_lenient(spark, sf):
    return moderation.apply_edits(incidents(spark, sf), view(spark, sf, _EDITS), strict=False
                                  ).select("incident_id", "type", "severity")


_BODIES = r"""
SELECT conv_id, turn, substring(b, 1, 2000) AS body,
       array_to_string(string_split(substring(b, 1, 2000), ' ')[1:10], ' ')
         || CASE WHEN len(string_split(trim(substring(b, 1, 2000)), ' ')) > 10 THEN '…' ELSE '' END AS title,
       'community' AS source, CASE role WHEN 'assistant' THEN 'publish' ELSE 'pending' END AS status
FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS b
      FROM conversations) WHERE b <> ''"""


def _bodies(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("incident_id"), "turn", F.col("text").alias("body"),
        F.col("role").alias("source"), (F.col("role") == "assistant").alias("auto_approve"))


@query("p12_validate_updates", f"""
SELECT conv_id AS incident_id, turn, md5(body) AS body_hash, title, source, status FROM ({_BODIES})""")
def p12(spark, sf):
    return moderation.validate_updates(_bodies(spark, sf)).select(
        "incident_id", "turn", F.md5("body").alias("body_hash"), "title", "source", "status")


@query("s15_update_rows_to_append", f"""
SELECT status, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM ({_BODIES}) GROUP BY 1""")
def s15(spark, sf):
    return moderation.validate_updates(_bodies(spark, sf)).groupBy("status").agg(
        F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


# -- rate limits ----------------------------------------------------------------------

def _greedy(valid: str, seconds: int) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, {valid} AS ok,
         row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM r),
  g AS (SELECT client, event_id, rn, us, ok, false AS limited,
               CASE WHEN ok THEN us END AS last FROM e WHERE rn = 1
        UNION ALL
        SELECT e.client, e.event_id, e.rn, e.us, e.ok,
               coalesce(e.us < g.last + {seconds * 1000000}, false),
               CASE WHEN e.ok AND NOT coalesce(e.us < g.last + {seconds * 1000000}, false) THEN e.us
                    ELSE g.last END
        FROM e JOIN g ON e.client = g.client AND e.rn = g.rn + 1)"""


@query("w09_greedy_rate_limit", with_views(_greedy("true", 6 * 3600) + """
SELECT event_id, NOT limited AS accepted, limited FROM g""", r=REQUESTS))
def w09(spark, sf):
    return ratelimit.greedy_accept(view(spark, sf, REQUESTS), "client", "ts", "event_id", 6 * 3600)


@query("v05_rate_limiter_with_condition", with_views(_greedy("latitude > 0", 2 * 3600) + """
SELECT event_id, ok AND NOT limited AS accepted, limited FROM g""", r=REQUESTS))
def v05(spark, sf):
    """The limiter as an extension point: own window, and only some requests use it up."""
    r = view(spark, sf, REQUESTS).withColumn("uses", F.col("latitude") > 0)
    return ratelimit.greedy_accept(r, "client", "ts", "event_id", 2 * 3600, consumes="uses")


_IN_BOX = "(latitude BETWEEN -5 AND 5 AND longitude BETWEEN 33.5 AND 42.5)"


@query("c28_accept_reports", with_views(_greedy(_IN_BOX, 6 * 3600) + """
SELECT event_id, CASE WHEN limited THEN 'rate_limited' WHEN NOT ok THEN 'out_of_bounds'
  ELSE 'accepted' END AS outcome FROM g""", r=REQUESTS))
def c28(spark, sf):
    return reports.accept_reports(view(spark, sf, REQUESTS), 6 * 3600).select(
        "event_id", "outcome")


@query("c28_accept_updates", with_views(_greedy("true", 3 * 3600) + """
SELECT g.event_id, CASE WHEN limited THEN 'rate_limited' WHEN o.o_orderkey IS NULL THEN 'no_incident'
  WHEN r.event_type = 'error' THEN 'empty_body' ELSE 'accepted' END AS outcome
FROM g JOIN r ON g.event_id = r.event_id LEFT JOIN orders o
  ON o.o_orderkey = r.event_id * 2 AND o.o_orderstatus <> 'P'""", r=REQUESTS))
def c28_updates(spark, sf):
    r = view(spark, sf, REQUESTS).withColumns({
        "incident_id": F.col("event_id") * 2,
        "body": F.when(F.col("event_type") == "error", "<p> </p>").otherwise("seen it")})
    i = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("incident_id"))
    return reports.accept_updates(r, i, 3 * 3600).select("event_id", "outcome")


@query("p23_report_defaults", with_views(f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'fire' ELSE event_type END AS type,
       'low' AS severity, 'pending' AS post_status,
       CASE WHEN event_type = 'view' THEN '' ELSE 'u' || client END AS reporter_name
FROM r WHERE {_IN_BOX}""", r=REQUESTS))
def p23(spark, sf):
    box = locate.DEFAULT_HOME.report_box
    r = view(spark, sf, REQUESTS).filter(locate.in_home(F.col("latitude"), F.col("longitude"), box))
    r = r.withColumns({"type": F.when(F.col("event_type") == "error", "").otherwise(
        F.col("event_type")), "is_anonymous": F.col("event_type") == "view",
        "reporter_name": F.concat(F.lit("u"), F.col("client").cast("string"))})
    return reports.report_incidents(r).select("event_id", "type", "severity", "post_status",
                                              "reporter_name")


# -- views ----------------------------------------------------------------------------

@query("p04_incident_view", with_views("""
SELECT incident_id, type, coalesce(is_verified, true) AS is_verified,
       coalesce(lifecycle, 'active') AS lifecycle, 'unsafe' AS status, update_count FROM i""",
    i=INCIDENTS))
def p04(spark, sf):
    none = F.lit(None).cast("string")
    i = incidents(spark, sf).withColumns({
        "status": F.lit(""), "video_url": none, "reporter_name": none, "location_name": none,
        "is_anonymous": F.lit(None).cast("boolean")})
    return moderation.incident_view(i).select("incident_id", "type", "is_verified", "lifecycle",
                                              "status", "update_count")


@query("p05_article_view", with_views("""
SELECT article_id, CASE WHEN tier = 5 THEN 3 ELSE tier END AS tier,
       CASE WHEN sentiment = 'negative' THEN 'neutral' ELSE sentiment END AS sentiment, 0 AS n_topics
FROM a""", a=ARTICLES))
def p05(spark, sf):
    a = articles(spark, sf).withColumns({
        "tier": F.when(F.col("tier") != 5, F.col("tier")), "bias_score": F.lit(None).cast("int"),
        "sentiment": F.when(F.col("sentiment") != "negative", F.col("sentiment")),
        "sentiment_score": F.lit(None).cast("double"),
        "topics": F.lit(None).cast("array<string>"), "keywords": F.lit(None).cast("array<string>")})
    return moderation.article_view(a).select("article_id", "tier", "sentiment",
                                             F.size("topics").alias("n_topics"))


@query("p05_social_view", """
SELECT doc_id AS post_id, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS platform,
       CASE WHEN lang = 'de' THEN 0 ELSE n_chars END AS engagement FROM documents""")
def p05_social(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("post_id"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
        .alias("platform"), F.col("source").alias("author_handle"), F.lit("").alias("post_url"),
        F.when(F.col("lang") != "de", F.col("n_chars")).alias("engagement"))
    return moderation.social_view(d).select("post_id", "platform", "engagement")


# -- dates ------------------------------------------------------------------------------

@query("dt01_parse_instants", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN epoch_us(TIMESTAMP '1998-01-01 00:00:00')
  ELSE epoch_us(o_orderdate) END AS us FROM orders""")
def dt01(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    text = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 1, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
            .otherwise("last week"))
    return o.select("o_orderkey", F.unix_micros(dates.parse_instant(text, INCIDENT_AS_OF))
                    .alias("us"))


@query("dt02_reissue_dates", """
SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS us FROM orders""")
def dt02(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("Text before. Reissued with updates to health: "),
                    F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" and more text."))
    return o.select("o_orderkey", F.unix_micros(dates.reissue_date(text)).alias("us"))


@query("dt03_last_updated_dates", """
SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS us FROM orders""")
def dt03(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("Safety. Last updated: "), F.date_format("o_orderdate", "dd.MM.yyyy"),
                    F.lit(" (unchanged)"))
    return o.select("o_orderkey", F.unix_micros(dates.last_updated_date(text)).alias("us"))


@query("dt04_age_seconds", """
SELECT o_orderkey, greatest(0, epoch_us(TIMESTAMP '1998-01-01 00:00:00') // 1000000
  - epoch_us(o_orderdate) // 1000000) AS age FROM orders""")
def dt04(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.age_seconds(
        F.col("o_orderdate"), INCIDENT_AS_OF).alias("age"))


@query("dt06_expiry_and_cooldown_ends", """
SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL '7' DAY) AS expires_us,
       epoch_us(o_orderdate + INTERVAL '168' HOUR) AS resume_us FROM orders""")
def dt06(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.unix_micros(dates.plus_hours(d, 24 * 7)).alias("expires_us"),
        F.unix_micros(dates.plus_hours(d, 168)).alias("resume_us"))


@query("dt07_local_date", """
SELECT event_id, CAST(CAST(ts + INTERVAL '3' HOUR AS DATE) AS VARCHAR) AS day FROM events""")
def dt07(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.local_date(
        F.col("ts"), "Africa/Nairobi").cast("string").alias("day"))


@query("dt08_cooldown_end", """
SELECT event_id, epoch_us(ts + INTERVAL '168' HOUR) AS until_us FROM events WHERE value < 30""")
def dt08(spark, sf):
    runs = view(spark, sf, RUNS).filter("articles_seen = 0")
    return runs.select("event_id", F.unix_micros(dates.plus_hours(F.col("run_at"), PAUSE_HOURS))
                       .alias("until_us"))


@query("dt09_query_time_restriction", with_views("""
SELECT article_id FROM a WHERE published_at > TIMESTAMP '2024-01-30 00:00:00'""", a=ARTICLES))
def dt09(spark, sf):
    a = articles(spark, sf)
    return a.filter(dates.in_window(F.col("published_at"), "2024-01-31 00:00:00", "24h")).select(
        "article_id")


@query("v04_place_candidate_udtf", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS candidate
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, {_place_sql('text')} AS l FROM documents))""")
def v04(spark, sf):
    """Candidates as a table function, for SQL users."""
    spark.udtf.register("place_candidates", candidate_udtf(TITLE_STOPS))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text")
                                                .alias("title"))
    return spark.sql("SELECT d.doc_id, c.pos, c.candidate FROM {d} d, "
                     "LATERAL place_candidates(d.title) c", d=docs)
