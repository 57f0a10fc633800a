"""Counts, rankings, trends, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import dates
from newsgrid.functions.records import parse_entities
from newsgrid.operators import counts, enrich, lifecycle, moderation
from newsgrid.operators.registry import circuit_breaker
from newsgrid.plans import trends
from newsgrid.plans.bindings import (
    ARTICLE_WORDS, ARTICLES, AS_OF, INCIDENT_AS_OF, INCIDENTS, META, POSTS, UPDATES, d_ascii,
    d_substrs, quoted, table, view, with_views,
)
from newsgrid.plans.registry import query
from newsgrid.session import dealt


def articles(spark, sf):
    return view(spark, sf, ARTICLES)


def heavy_articles(spark, sf):
    """The same rows, dealt out if the session asks for it."""
    return dealt(articles(spark, sf))


def incidents(spark, sf):
    return view(spark, sf, INCIDENTS)


def updates(spark, sf):
    return view(spark, sf, UPDATES)


def events_as_articles(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("article_id"), F.col("event_type").alias("source"),
        F.col("ts").alias("published_at"), "value", "props")


_HEALTH = """
SELECT source, total, in_window, epoch_us(last_seen) AS last_seen_us, age_sec,
       CASE WHEN age_sec < 7200 THEN 'fresh' WHEN age_sec < 86400 THEN 'stale' ELSE 'down' END
         AS status
FROM (SELECT source, count(*) AS total,
             CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{since}') AS BIGINT) AS in_window,
             max(ts) AS last_seen,
             greatest(0, epoch_us(TIMESTAMP '{now}') // 1000000 - epoch_us(max(ts)) // 1000000)
               AS age_sec
      FROM {src} GROUP BY source) ORDER BY last_seen DESC, source LIMIT 60
"""


def _flat_health(df):
    return df.select("source", "total", "in_window", F.unix_micros("last_seen")
                     .alias("last_seen_us"), "age_sec", "status")


@query("c17_source_health", _HEALTH.format(
    since="2024-01-30 00:00:00", now=AS_OF,
    src="(SELECT event_type AS source, ts FROM events)"))
def c17(spark, sf):
    return _flat_health(counts.source_health(events_as_articles(spark, sf), AS_OF, "24h", limit=60))


@query("a08_source_health_from_attributes", with_views(_HEALTH.format(
    since="2001-07-25 00:00:00", now="2001-08-01 00:00:00",
    src="(SELECT m.meta_value AS source, p.date_gmt AS ts FROM posts_v p JOIN meta_v m "
        "ON m.post_id = p.post_id AND m.meta_key = 'source' WHERE p.post_status = 'publish')"),
    posts_v=POSTS, meta_v=META))
def a08(spark, sf):
    from newsgrid.operators.eav import posts_with_key
    posts = view(spark, sf, POSTS).filter(F.col("post_status") == "publish")
    rows = posts_with_key(posts, view(spark, sf, META), "source")
    return _flat_health(counts.source_health(rows, "2001-08-01 00:00:00", "7d", ts="date_gmt",
                                             limit=60))


@query("p29_freshness_by_source", """
SELECT event_type AS source, CASE WHEN age < 7200 THEN 'fresh' WHEN age < 86400 THEN 'stale'
       ELSE 'down' END AS status, count(*) AS n
FROM (SELECT event_type, greatest(0, epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000000
             - epoch_us(ts) // 1000000) AS age FROM events) GROUP BY 1, 2
""")
def p29(spark, sf):
    e = events_as_articles(spark, sf)
    age = dates.age_seconds(F.col("published_at"), AS_OF)
    return e.groupBy("source", counts.freshness(age).alias("status")).agg(F.count("*").alias("n"))


@query("p07_window_filter", """
SELECT w AS "window", event_type AS source, count(*) AS n
FROM events, (VALUES ('1h', 3600), ('24h', 86400), ('7d', 604800), ('30d', 2592000),
                     ('other', 86400)) AS t(w, s)
WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - s * INTERVAL '1' SECOND GROUP BY 1, 2
""")
def p07(spark, sf):
    e = events_as_articles(spark, sf)
    now = "2024-01-30 12:00:00"
    # One scan for all five windows.
    tagged = e.select("source", F.explode(F.array(*[
        F.when(dates.in_window(F.col("published_at"), now, w), F.lit(w))
        for w in ("1h", "24h", "7d", "30d", "other")])).alias("window"))
    return tagged.filter(F.col("window").isNotNull()).groupBy("window", "source").agg(
        F.count("*").alias("n"))


@query("a01_count_by_source", with_views("""
SELECT source, count(*) AS n FROM a GROUP BY source
ORDER BY n DESC, max(published_at) DESC, source LIMIT 15""", a=ARTICLES))
def a01(spark, sf):
    a = articles(spark, sf).withColumn("_age", -F.unix_micros("published_at"))
    return counts.top_counts(a, "source", 15, order="_age")


def _topic_counts_sql() -> str:
    parts = ", ".join(
        f"({i}, '{name}', {d_substrs('low', terms)})"
        for i, (name, terms) in enumerate(ARTICLE_WORDS.topics.items()))
    return f"""
    SELECT article_id, published_at, topic, cnt,
           row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, ord) AS rk
    FROM (SELECT article_id, published_at,
                 lower(trim(title || chr(10) || content)) AS low FROM a) x,
         LATERAL (SELECT * FROM (VALUES {parts}) AS t(ord, topic, cnt)) y
    WHERE cnt > 0"""


def _topics(df):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return df.withColumn("topics", enrich.topics(text, ARTICLE_WORDS.topics))


@query("a02_count_by_topic", with_views(f"""
SELECT topic, count(*) AS n FROM ({_topic_counts_sql()}) WHERE rk <= 4
GROUP BY topic ORDER BY n DESC, topic LIMIT 10""", a=ARTICLES))
def a02(spark, sf):
    exploded = _topics(heavy_articles(spark, sf)).select(F.explode("topics").alias("topic"))
    return counts.top_counts(exploded, "topic", 10)


@query("a03_count_by_sentiment", with_views("""
SELECT count(*) FILTER (WHERE sentiment = 'positive') AS n_positive,
       count(*) FILTER (WHERE sentiment = 'neutral') AS n_neutral,
       count(*) FILTER (WHERE sentiment = 'negative') AS n_negative FROM a""", a=ARTICLES))
def a03(spark, sf):
    return counts.fixed_counts(articles(spark, sf), "sentiment", trends.SENTIMENTS, "n_")


@query("a04_count_by_tier", with_views("""
SELECT """ + ", ".join(f"count(*) FILTER (WHERE tier = {t}) AS tier_{t}" for t in range(1, 6))
    + " FROM a", a=ARTICLES))
def a04(spark, sf):
    return counts.fixed_counts(articles(spark, sf), "tier", trends.TIERS, "tier_")


def _span_sql(pattern: str, text: str = "title || chr(10) || content") -> str:
    return f"regexp_extract_all({d_ascii(f'trim({text})')}, '{pattern}')"


_SPANS = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
_ENTITY_ROWS = f"""
SELECT article_id, published_at, s, pos, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS rk
FROM (SELECT article_id, published_at, s, min(pos) AS pos
      FROM (SELECT article_id, published_at, unnest(l) AS s, generate_subscripts(l, 1) AS pos
            FROM (SELECT article_id, published_at, {_span_sql(_SPANS)} AS l FROM a))
      WHERE lower(s) NOT IN ({quoted(ARTICLE_WORDS.stop)})
      GROUP BY article_id, published_at, s)
"""


@query("a05_top_entities", with_views(f"""
SELECT 'persons' AS kind, s AS name, count(*) AS n FROM ({_ENTITY_ROWS}) WHERE rk <= 10
GROUP BY s ORDER BY n DESC, s LIMIT 10""", a=ARTICLES))
def a05(spark, sf):
    """Entities stored as JSON, parsed back, exploded and ranked per kind."""
    a = articles(spark, sf)
    text = enrich.article_text(F.col("title"), F.col("content"))
    stored = a.select(F.to_json(enrich.entities(text, ARTICLE_WORDS.stop)).alias("entities_json"))
    e = stored.select(F.explode(F.map_from_arrays(
        F.array(F.lit("persons"), F.lit("orgs"), F.lit("places")),
        F.array(*[parse_entities(F.col("entities_json"))[k]
                  for k in ("persons", "orgs", "places")]))).alias("kind", "names"))
    flat = e.select("kind", F.explode("names").alias("name"))
    from newsgrid.operators.grouped import top_per_group
    n = flat.groupBy("kind", "name").agg(F.count("*").alias("n"))
    return top_per_group(n, ["kind"], [F.desc("n"), F.asc("name")], 10).drop("rank")


@query("a06_daily_timeline", """
SELECT CAST(CAST(ts + INTERVAL '3' HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n
FROM events GROUP BY 1 ORDER BY 1""")
def a06(spark, sf):
    d = counts.daily_counts(events_as_articles(spark, sf), "published_at", "Africa/Nairobi")
    return d.select(F.col("day").cast("string").alias("day"), "n")


_TREND_SQL = f"""
WITH w AS (SELECT * FROM a WHERE published_at > TIMESTAMP '2024-01-24 00:00:00'),
     topics AS (SELECT * FROM ({_topic_counts_sql()}) WHERE rk <= 4),
     ents AS (SELECT * FROM ({_ENTITY_ROWS}) WHERE rk <= 10),
     ranked AS (
       SELECT 'source' AS facet, source AS key, count(*) AS n, row_number() OVER (
                ORDER BY count(*) DESC, max(struct_pack(t := published_at, i := article_id)) DESC)
                AS rank FROM w GROUP BY source
       UNION ALL
       SELECT 'topic', topic, count(*), row_number() OVER (ORDER BY count(*) DESC,
                max(struct_pack(t := published_at, i := article_id, p := -rk)) DESC)
       FROM topics WHERE published_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY topic
       UNION ALL
       SELECT 'person', s, count(*), row_number() OVER (ORDER BY count(*) DESC,
                max(struct_pack(t := published_at, i := article_id, p := -rk)) DESC)
       FROM ents WHERE published_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY s)
SELECT facet, CAST(rank AS INTEGER) AS rank, key, n FROM ranked
WHERE rank <= CASE facet WHEN 'source' THEN 15 ELSE 10 END
UNION ALL SELECT 'total', 0, 'all', count(*) FROM w HAVING count(*) > 0
UNION ALL SELECT 'sentiment', 0, sentiment, count(*) FROM w GROUP BY sentiment
UNION ALL SELECT 'tier', 0, CAST(tier AS VARCHAR), count(*) FROM w GROUP BY tier
UNION ALL SELECT 'day', 0, CAST(CAST(published_at AS DATE) AS VARCHAR), count(*) FROM w GROUP BY 3
"""


def _trend_articles(spark, sf):
    a = heavy_articles(spark, sf)
    text = enrich.article_text(F.col("title"), F.col("content"))
    return _topics(a).withColumn("entities", enrich.entities(text, ARTICLE_WORDS.stop)).drop(
        "content")


@query("a07_trend_facets", with_views(_TREND_SQL, a=ARTICLES))
def a07(spark, sf):
    return trends.trend_facets(_trend_articles(spark, sf), AS_OF, "7d")


@query("c16_trend_snapshot", with_views(f"""
WITH f AS ({with_views(_TREND_SQL, a=ARTICLES)})
SELECT '7d' AS "window", CAST(sum(n) FILTER (WHERE facet = 'total') AS BIGINT) AS total,
       string_agg(key || '=' || n, ',' ORDER BY rank) FILTER (WHERE facet = 'source') AS by_source,
       string_agg(key || '=' || n, ',' ORDER BY rank) FILTER (WHERE facet = 'topic') AS by_topic,
       string_agg(key || '=' || n, ',' ORDER BY rank) FILTER (WHERE facet = 'person') AS persons,
       string_agg(key || '=' || n, ',' ORDER BY key) FILTER (WHERE facet = 'day') AS timeline,
       CAST(coalesce(sum(n) FILTER (WHERE facet = 'sentiment' AND key = 'negative'), 0) AS BIGINT)
         AS negative,
       CAST(coalesce(sum(n) FILTER (WHERE facet = 'tier' AND key = '1'), 0) AS BIGINT) AS tier_1
FROM f""", dummy="SELECT 1"))
def c16(spark, sf):
    def flat(c):
        return F.array_join(F.transform(c, lambda x: F.concat(
            x["name"], F.lit("="), x["count"].cast("string"))), ",")
    s = trends.trend_snapshot(_trend_articles(spark, sf), AS_OF, "7d")
    return s.select("window", "total", flat(F.col("by_source")).alias("by_source"),
                    flat(F.col("by_topic")).alias("by_topic"),
                    flat(F.col("persons")).alias("persons"),
                    flat(F.col("timeline")).alias("timeline"),
                    F.col("by_sentiment.negative").alias("negative"),
                    F.col("by_tier.t1").alias("tier_1"))


@query("a09_unique_sources", with_views("SELECT count(DISTINCT source) AS sources FROM a",
                                        a=ARTICLES))
def a09(spark, sf):
    return articles(spark, sf).agg(F.countDistinct("source").alias("sources"))


@query("a10_count_per_lifecycle", with_views("""
SELECT coalesce(lifecycle, 'active') AS lifecycle, count(*) AS n FROM i GROUP BY 1""",
    i=INCIDENTS))
def a10(spark, sf):
    return counts.lifecycle_counts(incidents(spark, sf))


@query("a11_count_per_update_status", with_views(
    "SELECT status, count(*) AS n FROM u GROUP BY status", u=UPDATES))
def a11(spark, sf):
    return counts.status_counts(updates(spark, sf))


@query("a12_pending_review_count", with_views("""
SELECT count(*) AS n FROM i WHERE post_status = 'pending' AND needs_review""", i=INCIDENTS))
def a12(spark, sf):
    return moderation.pending_review(incidents(spark, sf)).agg(F.count("*").alias("n"))


_BOARD = """
SELECT (SELECT count(*) FROM i WHERE post_status = 'pending' AND needs_review) AS pending_review,
       (SELECT count(*) FROM u WHERE status = 'pending') AS pending_updates,
       (SELECT {cap} FROM i WHERE post_status = 'publish'
          AND coalesce(lifecycle, 'active') <> 'developing'
          AND expires_at BETWEEN TIMESTAMP '1997-12-31 00:00:00' AND TIMESTAMP '1998-01-02 00:00:00')
         AS expiring,
       (SELECT count(*) FROM i WHERE post_status = 'publish') AS incidents,
       (SELECT round(100.0 * count(*) FILTER (WHERE coalesce(ai_model, '') <> '') / count(*))
          FROM i WHERE post_status = 'publish') AS ai_percent
"""


@query("c27_ops_dashboard", with_views(_BOARD.format(cap="count(*)"), i=INCIDENTS, u=UPDATES))
def c27(spark, sf):
    return counts.ops_dashboard(incidents(spark, sf), updates(spark, sf), INCIDENT_AS_OF)


@query("a13_ops_dashboard_display", with_views(_BOARD.format(cap="least(100, count(*))"),
                                               i=INCIDENTS, u=UPDATES))
def a13(spark, sf):
    return counts.ops_dashboard(incidents(spark, sf), updates(spark, sf), INCIDENT_AS_OF,
                                shown=100)


@query("a14_ai_backlog", with_views("""
SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(ai_model, '') <> '') AS analysed,
       greatest(0, count(*) - count(*) FILTER (WHERE coalesce(ai_model, '') <> '')) AS needs_ai
FROM i WHERE post_status = 'publish'""", i=INCIDENTS))
def a14(spark, sf):
    return counts.ai_backlog(incidents(spark, sf))


_RECORDS = """
SELECT 'incident' AS record_type, post_status FROM i
UNION ALL SELECT 'update', status FROM u UNION ALL SELECT 'article', 'publish' FROM a
"""


@query("a15_records_per_type_and_status", with_views(f"""
SELECT record_type, post_status, count(*) AS n FROM ({_RECORDS})
GROUP BY ROLLUP (record_type, post_status)""", i=INCIDENTS, u=UPDATES, a=ARTICLES))
def a15(spark, sf):
    posts = (incidents(spark, sf).select(F.lit("incident").alias("record_type"), "post_status")
             .unionByName(updates(spark, sf).select(F.lit("update").alias("record_type"),
                                                    F.col("status").alias("post_status")))
             .unionByName(articles(spark, sf).select(F.lit("article").alias("record_type"),
                                                     F.lit("publish").alias("post_status"))))
    return counts.type_status_counts(posts)


@query("a16_run_funnel", """
SELECT event_type AS source, count(*) AS seen,
       count(*) FILTER (WHERE value < 5) AS already_seen,
       count(*) FILTER (WHERE value >= 5 AND value < 10) AS prefilter_dropped,
       count(*) FILTER (WHERE value >= 10) AS scorer_checked,
       count(*) FILTER (WHERE value >= 10 AND value < 20) AS scorer_rejected,
       count(*) FILTER (WHERE value >= 20) AS incidents
FROM events GROUP BY event_type""")
def a16(spark, sf):
    e = events_as_articles(spark, sf)
    v = F.col("value")
    out = (F.when(v < 5, "already_seen").when(v < 10, "prefilter_dropped")
           .when(v < 20, "rejected").otherwise("incident"))
    return counts.run_funnel(e.withColumn("outcome", out))


@query("a18_sweep_counts", with_views("""
SELECT count(*) FILTER (WHERE post_status = 'publish' AND st = 'active'
                        AND last < TIMESTAMP '1997-12-25 00:00:00') AS resolved,
       count(*) FILTER (WHERE post_status = 'publish' AND st IN ('active', 'resolved')
                        AND last < TIMESTAMP '1997-12-02 00:00:00') AS archived
FROM (SELECT *, coalesce(lifecycle, 'active') AS st,
             coalesce(last_update_at, incident_time, modified_at) AS last FROM i)""",
    i=INCIDENTS))
def a18(spark, sf):
    return lifecycle.sweep_counts(lifecycle.age_incidents(incidents(spark, sf), INCIDENT_AS_OF))


@query("a23_fix_queue_pages", with_views("""
SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM i
WHERE post_status = 'publish' AND (needs_review OR location_precision = 'country')""",
    i=INCIDENTS))
def a23(spark, sf):
    return moderation.page_count(moderation.needs_location_fix(incidents(spark, sf)))


_SOON = """
FROM i WHERE post_status = 'publish' AND coalesce(lifecycle, 'active') <> 'developing'
  AND expires_at BETWEEN TIMESTAMP '1997-12-31 00:00:00' AND TIMESTAMP '1998-01-02 00:00:00'
"""


@query("a24_expiring_soon_count", with_views("SELECT count(*) AS n" + _SOON, i=INCIDENTS))
def a24(spark, sf):
    return lifecycle.expiring_soon(incidents(spark, sf), INCIDENT_AS_OF).agg(
        F.count("*").alias("n"))


@query("f01_top_keys_by_first_appearance", with_views("""
SELECT cust_id, count(*) AS n FROM i GROUP BY cust_id
ORDER BY n DESC, min(incident_id), cust_id LIMIT 25""", i=INCIDENTS))
def f01(spark, sf):
    return counts.top_counts(incidents(spark, sf), "cust_id", 25, order="incident_id")


@query("f02_newest_page", with_views("""
SELECT incident_id, epoch_us(created_at) AS created_us, title, (SELECT count(*) FROM i) AS total FROM i
ORDER BY created_at DESC, incident_id DESC LIMIT 200 OFFSET 150""", i=INCIDENTS))
def f02(spark, sf):
    p = moderation.newest_page(incidents(spark, sf), 500, 150, total="total")  # 500 is clamped to 200
    return p.select("incident_id", F.unix_micros("created_at").alias("created_us"), "title", "total")


@query("f03_newest_in_window", with_views("""
SELECT article_id, source FROM a WHERE published_at > TIMESTAMP '2024-01-24 00:00:00'
ORDER BY published_at DESC, article_id DESC LIMIT 500""", a=ARTICLES))
def f03(spark, sf):
    return trends.recent(articles(spark, sf), AS_OF, "7d", max_rows=500).select(
        "article_id", "source")


@query("f04_expiring_soon_list", with_views(
    "SELECT incident_id, epoch_us(expires_at) AS expires_us" + _SOON
    + " ORDER BY expires_at, incident_id LIMIT 50", i=INCIDENTS))
def f04(spark, sf):
    return lifecycle.expiring_soon(incidents(spark, sf), INCIDENT_AS_OF, limit=50).select(
        "incident_id", F.unix_micros("expires_at").alias("expires_us"))


@query("f05_recent_analyses", with_views("""
SELECT incident_id, ai_model FROM i WHERE post_status = 'publish' AND coalesce(ai_model, '') <> ''
ORDER BY created_at DESC, incident_id DESC LIMIT 15""", i=INCIDENTS))
def f05(spark, sf):
    return moderation.recent_analyses(incidents(spark, sf)).select("incident_id", "ai_model")


@query("f06_recent_articles", with_views("""
SELECT article_id, source, sentiment, tier FROM a ORDER BY published_at DESC, article_id DESC
LIMIT 25""", a=ARTICLES))
def f06(spark, sf):
    return moderation.recent_articles(articles(spark, sf)).select(
        "article_id", "source", "sentiment", "tier")


@query("f07_timeline_by_day", with_views("""
SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM a
GROUP BY 1 ORDER BY 1""", a=ARTICLES))
def f07(spark, sf):
    d = counts.daily_counts(articles(spark, sf), "published_at")
    return d.select(F.col("day").cast("string").alias("day"), "n")


@query("f08_health_panel_order", with_views(_HEALTH.format(
    since="2024-01-24 00:00:00", now=AS_OF, src="(SELECT source, published_at AS ts FROM a)"),
    a=ARTICLES))
def f08(spark, sf):
    return _flat_health(counts.source_health(articles(spark, sf), AS_OF, "7d", limit=60))


@query("p14_recent_by_source_and_topic", with_views(f"""
SELECT article_id, source FROM a
WHERE source = 'src3' AND article_id IN (
  SELECT article_id FROM ({_topic_counts_sql()}) WHERE rk <= 4 AND topic = 'economy')
ORDER BY published_at DESC, article_id DESC LIMIT 25""", a=ARTICLES))
def p14(spark, sf):
    return moderation.recent_articles(_topics(articles(spark, sf)), "src3", "economy").select(
        "article_id", "source")


_ISLANDS = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY run_at, event_id) AS rn
           FROM (SELECT event_type AS label, ts AS run_at, event_id,
                        CASE WHEN value < 30 THEN 0 ELSE CAST(floor(value) AS INTEGER) END
                          AS articles_seen FROM events)),
     s AS (SELECT *, rn - coalesce(max(CASE WHEN articles_seen > 0 THEN rn END) OVER w, 0) AS zero_runs,
                  last_value(CASE WHEN articles_seen > 0 THEN articles_seen END IGNORE NULLS) OVER w
                    AS last_articles
           FROM r WINDOW w AS (PARTITION BY label ORDER BY run_at, event_id
                               ROWS UNBOUNDED PRECEDING))
"""


@query("w07_zero_yield_streaks", _ISLANDS + """
SELECT event_id, label, zero_runs FROM s""")
def w07(spark, sf):
    from newsgrid.operators.grouped import zero_streaks
    from newsgrid.plans.bindings import RUNS
    return zero_streaks(view(spark, sf, RUNS), tie="event_id").select(
        "event_id", "label", "zero_runs")


@query("w08_running_source_statistics", _ISLANDS + """
SELECT event_id, label, last_articles FROM s""")
def w08(spark, sf):
    from newsgrid.operators.grouped import zero_streaks
    from newsgrid.plans.bindings import RUNS
    return zero_streaks(view(spark, sf, RUNS), tie="event_id", bucket_seconds=3 * 86400).select(
        "event_id", "label", "last_articles")


@query("c22_source_circuit_breaker", _ISLANDS + """
SELECT label, epoch_us(run_at) AS last_run_us, last_articles,
       CASE WHEN zero_runs = 0 THEN 0 ELSE (zero_runs - 1) % 2 + 1 END AS zero_runs,
       CASE WHEN zero_runs > 0 AND (zero_runs - 1) % 2 + 1 = 2
            THEN epoch_us(run_at + INTERVAL '168' HOUR) END AS disabled_until_us,
       NOT (zero_runs > 0 AND (zero_runs - 1) % 2 + 1 = 2) AS should_run
FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY run_at DESC, event_id DESC) = 1""")
def c22(spark, sf):
    from newsgrid.plans.bindings import RUNS
    s = circuit_breaker(view(spark, sf, RUNS), AS_OF, threshold=2, tie="event_id")
    return s.select("label", F.unix_micros("last_run").alias("last_run_us"), "last_articles",
                    "zero_runs", F.unix_micros("disabled_until").alias("disabled_until_us"),
                    "should_run")


@query("p26_sources_in_cooldown_dropped", _ISLANDS + """
SELECT label AS id FROM s
QUALIFY row_number() OVER (PARTITION BY label ORDER BY run_at DESC, event_id DESC) = 1
   AND NOT (zero_runs > 0 AND (zero_runs - 1) % 2 + 1 = 2)""")
def p26(spark, sf):
    from newsgrid.operators.registry import runnable
    from newsgrid.plans.bindings import RUNS
    runs = view(spark, sf, RUNS)
    sources = runs.select(F.col("label").alias("id")).distinct()
    return runnable(sources, circuit_breaker(runs, AS_OF, threshold=2, tie="event_id"))
