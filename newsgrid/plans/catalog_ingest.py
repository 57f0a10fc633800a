"""Scans, registries, de-duplication, set operations, sinks, views over attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import arrays
from newsgrid.operators import dedupe, eav, moderation, registry
from newsgrid.operators.grouped import capped_by_source
from newsgrid.operators.locate import county_tree, place_candidates
from newsgrid.plans.bindings import (
    ARTICLES, AS_OF, INCIDENTS, META, POSTS, SEEN, STORE, TITLE_STOPS, UPDATES, d_any, table, view,
    with_views,
)
from newsgrid.plans.catalog_counts import articles, incidents, updates
from newsgrid.plans.catalog_text import _place_sql
from newsgrid.plans.ingest import dedupe_and_ingest
from newsgrid.plans.registry import query
from newsgrid.session import scratch
from newsgrid.sources import landed, sinks
from newsgrid.sources.reference import county_table

def first():
    return [F.asc("article_id")]


def seen(spark, sf):
    return view(spark, sf, SEEN)


def store(spark, sf):
    return view(spark, sf, STORE)


_DEDUP = """SELECT min(article_id) AS article_id, url FROM a GROUP BY url"""


@query("w01_keep_first_per_url", with_views(_DEDUP, a=ARTICLES))
def w01(spark, sf):
    return dedupe.first_per_url(articles(spark, sf).select("article_id", "url"), first())


@query("j01_drop_seen_urls", with_views("""
SELECT article_id, url FROM a WHERE url NOT IN (SELECT url FROM s)""", a=ARTICLES, s=SEEN))
def j01(spark, sf):
    return dedupe.drop_seen(articles(spark, sf).select("article_id", "url"), seen(spark, sf))


@query("j02_existing_article_ids", with_views("""
SELECT a.article_id, x.existing_id FROM a LEFT JOIN (
  SELECT url, min(stored_id) AS existing_id FROM t WHERE post_status IN ('publish', 'pending', 'draft')
  GROUP BY url) x ON a.url = x.url""", a=ARTICLES, t=STORE))
def j02(spark, sf):
    return dedupe.existing_ids(articles(spark, sf), store(spark, sf), "stored_id").select(
        "article_id", "existing_id")


@query("j03_insert_incidents_if_absent", with_views("""
SELECT min(incident_id) AS incident_id, source_url FROM i
WHERE source_url NOT IN (SELECT concat('https://news.example/', CAST(c_custkey AS VARCHAR(20)))
                         FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
GROUP BY source_url""", i=INCIDENTS))
def j03(spark, sf):
    have = table(spark, sf, "customer").select(
        F.concat(F.lit("https://news.example/"), F.col("c_custkey").cast("string"))
        .alias("source_url"),
        F.when(F.col("c_mktsegment") == "BUILDING", "publish")
        .when(F.col("c_mktsegment") == "MACHINERY", "pending").otherwise("trash")
        .alias("post_status"))
    out = dedupe.insert_if_absent(incidents(spark, sf), have, [F.asc("incident_id")],
                                  url="source_url", store_url="source_url")
    return out.select("incident_id", "source_url")


@query("j04_posts_with_attribute", with_views("""
SELECT p.post_id, p.post_status, m.meta_value AS author FROM p JOIN m
  ON m.post_id = p.post_id AND m.meta_key = 'author'""", p=POSTS, m=META))
def j04(spark, sf):
    return eav.posts_with_key(view(spark, sf, POSTS), view(spark, sf, META), "author").select(
        "post_id", "post_status", "author")


@query("s10_attributes_to_wide_rows", with_views("""
SELECT p.post_id, p.post_status, p.record_type,
       coalesce(min_by(m.meta_value, m.meta_id) FILTER (WHERE m.meta_key = 'source'), '') AS source,
       coalesce(CAST(min_by(m.meta_value, m.meta_id) FILTER (WHERE m.meta_key = 'author') AS BIGINT),
                0) AS author,
       coalesce(min_by(m.meta_value, m.meta_id) FILTER (WHERE m.meta_key = 'status'), 'unsafe')
         AS status, true AS is_verified
FROM p LEFT JOIN m ON p.post_id = m.post_id GROUP BY 1, 2, 3""", p=POSTS, m=META))
def s10(spark, sf):
    spec = {"source": ("string", ""), "author": ("bigint", 0), "status": ("string", "unsafe"),
            "is_verified": ("boolean", True)}
    return eav.widen(view(spark, sf, POSTS), view(spark, sf, META), spec).drop("date_gmt")


@query("c14_dedupe_and_ingest", with_views(f"""
SELECT article_id, url FROM ({_DEDUP}) WHERE url NOT IN (SELECT url FROM s)
  AND url NOT IN (SELECT url FROM t WHERE post_status = 'publish')""",
    a=ARTICLES, s=SEEN, t=STORE))
def c14(spark, sf):
    return dedupe_and_ingest(articles(spark, sf), store(spark, sf), seen(spark, sf),
                             first()).select("article_id", "url")


@query("s01_union_of_sources", """
SELECT 'order' AS source, o_orderkey AS article_id, NULL AS tier, o_orderpriority AS title FROM orders
UNION ALL SELECT 'customer', c_custkey, NULL, c_name FROM customer
UNION ALL SELECT 'nation', n_nationkey, n_regionkey, n_name FROM nation""")
def s01(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("order").alias("source"),
                                          F.col("o_orderkey").alias("article_id"),
                                          F.col("o_orderpriority").alias("title"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"),
                                            F.col("c_custkey").alias("article_id"),
                                            F.col("c_name").alias("title"))
    n = table(spark, sf, "nation").select(F.lit("nation").alias("source"),
                                          F.col("n_nationkey").cast("long").alias("article_id"),
                                          F.col("n_regionkey").alias("tier"),
                                          F.col("n_name").alias("title"))
    return landed.union_sources([o, c, n])


@query("u01_union_of_article_frames", with_views("""
SELECT source, count(*) AS n FROM (
  SELECT source FROM a UNION ALL SELECT event_type FROM events
  UNION ALL SELECT role FROM conversations) GROUP BY source""", a=ARTICLES))
def u01(spark, sf):
    frames = [articles(spark, sf).select("source", "title"),
              table(spark, sf, "events").select(F.col("event_type").alias("source")),
              table(spark, sf, "conversations").select(F.col("role").alias("source"),
                                                       F.col("text").alias("content"))]
    return landed.union_sources(frames).groupBy("source").agg(F.count("*").alias("n"))


# Registry: the sources of the documents, with an order, a tier and a cap derived from them.
_REG = """
SELECT source AS id, source AS name, CAST(min(doc_id) AS INTEGER) AS ord,
       CAST(count(*) % 3 + 2 AS INTEGER) AS max_per_run,
       CASE WHEN min(doc_id) % 2 = 0 THEN 'fast' ELSE 'slow' END AS cadence,
       CASE WHEN source = 'src4' THEN false WHEN source <> 'src5' THEN true END AS enabled
FROM {documents} GROUP BY source
UNION ALL SELECT source, concat(source, ' again'), CAST(max(doc_id) AS INTEGER), 1, 'fast', true
FROM {documents} GROUP BY source
"""


def reg(spark, sf):
    return view(spark, sf, _REG)


_FAST = """SELECT id, name, ord FROM r WHERE coalesce(enabled, true) AND cadence = 'fast'
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1"""


@query("s02_active_registry", with_views(_FAST, r=_REG))
def s02(spark, sf):
    return registry.active_sources(reg(spark, sf), "fast").select("id", "name", "ord")


@query("s03_social_registry", with_views("""
SELECT id, name, ord FROM r WHERE coalesce(enabled, true) AND cadence = 'fast'""", r=_REG))
def s03(spark, sf):
    return registry.active_social_sources(reg(spark, sf), "fast").select("id", "name", "ord")


@query("w02_first_per_registry_id", with_views("""
SELECT id, name, ord FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""",
    r=_REG))
def w02(spark, sf):
    return registry.active_sources(reg(spark, sf), only_enabled=False).select("id", "name", "ord")


@query("w03_per_source_cap_and_budget", with_views(f"""
WITH k AS ({_FAST.replace("id, name, ord FROM", "id, ord, max_per_run FROM")}),
     n AS (SELECT a.article_id, k.ord, k.max_per_run,
                  row_number() OVER (PARTITION BY source ORDER BY published_at DESC, article_id) AS n
           FROM a JOIN k ON a.source = k.id)
SELECT article_id FROM n WHERE n <= max_per_run ORDER BY ord, n LIMIT 30""", r=_REG, a=ARTICLES))
def w03(spark, sf):
    r = registry.active_sources(reg(spark, sf), "fast")
    return capped_by_source(articles(spark, sf), r, "source",
                            [F.desc("published_at"), F.asc("article_id")], 30).select("article_id")


@query("j13_named_source_wins", with_views("""
SELECT id, name FROM (SELECT DISTINCT source AS id, 'named' AS name FROM a WHERE lang = 'en' AND
                      source LIKE 'src1%')
UNION ALL SELECT id, name FROM r WHERE id NOT LIKE 'src1%'""", r=_REG, a=ARTICLES))
def j13(spark, sf):
    named = (articles(spark, sf).filter((F.col("lang") == "en") & F.col("source").like("src1%"))
             .select(F.col("source").alias("id"), F.lit("named").alias("name")).distinct())
    return registry.named_first(named, reg(spark, sf)).select("id", "name")


@query("p28_source_subset", with_views("""
SELECT article_id, source FROM a WHERE source IN ('src1', 'src7', 'none')""", a=ARTICLES))
def p28(spark, sf):
    return registry.only_sources(articles(spark, sf), ["src1", "src7", "none"]).select(
        "article_id", "source")


@query("u02_union_of_country_tables", """
SELECT n_name AS name, CAST(n_regionkey AS DOUBLE) AS min_lat FROM nation WHERE n_regionkey = 0
UNION ALL SELECT n_name, NULL FROM nation WHERE n_regionkey <> 0""")
def u02(spark, sf):
    n = table(spark, sf, "nation")
    priority = n.filter("n_regionkey = 0").select(
        F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("min_lat"))
    world = n.filter("n_regionkey <> 0").select(F.col("n_name").alias("name"))
    return landed.union_sources([priority, world])


@query("u03_feed_rows_before_page_rows", with_views("""
SELECT url, origin, article_id FROM (
  SELECT url, 'feed' AS origin, article_id, 0 AS p FROM a WHERE lang IN ('en', 'de')
  UNION ALL SELECT url, 'page', article_id, 1 FROM a)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, article_id) = 1""", a=ARTICLES))
def u03(spark, sf):
    from newsgrid.sources.pages import feed_then_pages
    a = articles(spark, sf).select("url", "article_id", "lang")
    feed = a.filter(F.col("lang").isin("en", "de")).withColumn("origin", F.lit("feed"))
    page = a.withColumn("origin", F.lit("page"))
    return feed_then_pages(feed, page, ["article_id"]).select("url", "origin", "article_id")


@query("u04_candidate_lists", with_views("""
SELECT article_id, array_to_string(list_transform(list_filter(p, lambda x: list_position(
         list_transform(p, lambda y: lower(y.v)), lower(x.v)) = x.i), lambda x: x.v), '|')
         AS candidates
FROM (SELECT article_id, list_transform(range(1, len(l) + 1), lambda i: struct_pack(v := l[i], i := i))
        AS p
      FROM (SELECT article_id, [source] || """ + _place_sql("title") + """ AS l FROM a))""",
    a=ARTICLES))
def u04(spark, sf):
    found = place_candidates(F.col("source"), F.col("title"), TITLE_STOPS)
    return articles(spark, sf).select("article_id", F.array_join(found, "|").alias("candidates"))


@query("u05_except_seen", with_views("SELECT url FROM a EXCEPT SELECT url FROM s",
                                     a=ARTICLES, s=SEEN))
def u05(spark, sf):
    return dedupe.drop_seen(articles(spark, sf).select("url").distinct(), seen(spark, sf))


@query("s12_article_rows_to_append", with_views("""
SELECT article_id, url, CAST(CAST(published_at AS DATE) AS VARCHAR) AS post_date
FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id) = 1)
WHERE url NOT IN (SELECT url FROM t WHERE post_status = 'publish')""", a=ARTICLES, t=STORE))
def s12(spark, sf):
    rows = sinks.article_rows(articles(spark, sf), store(spark, sf), first(), AS_OF)
    return rows.select("article_id", "url", F.col("post_date").cast("string").alias("post_date"))


@query("s13_incident_rows_to_append", with_views("""
SELECT incident_id, CASE WHEN needs_review THEN 'pending' ELSE 'publish' END AS post_status,
       coalesce(is_verified, NOT needs_review) AS is_verified
FROM i QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY incident_id) = 1""",
    i=INCIDENTS))
def s13(spark, sf):
    i = incidents(spark, sf)
    none = i.limit(0).select("source_url", "post_status")
    return sinks.incident_rows(i, none, [F.asc("incident_id")]).select(
        "incident_id", "post_status", "is_verified")


@query("s14_social_posts_to_append", """
SELECT conv_id, turn FROM conversations WHERE trim(substring(text, 1, 100)) <> ''""")
def s14(spark, sf):
    posts = table(spark, sf, "conversations").withColumn("title", F.substring("text", 1, 100))
    path = scratch(spark)
    sinks.append_social_posts(posts, path)
    return spark.read.parquet(path).select("conv_id", "turn")


@query("s16_seen_set_append", with_views("""
SELECT (SELECT count(*) FROM s) AS before, (SELECT count(*) FROM (
          SELECT url FROM a EXCEPT SELECT url FROM s)) AS added""", a=ARTICLES, s=SEEN))
def s16(spark, sf):
    s = seen(spark, sf)
    added = dedupe.mark_seen(s, articles(spark, sf), AS_OF).select("url", F.lit(1).alias("new"))
    both = s.select("url", F.lit(0).alias("new")).unionByName(added)
    return both.agg(F.count_if(F.col("new") == 0).alias("before"),
                    F.count_if(F.col("new") == 1).alias("added"))


@query("s18_run_metrics", with_views("""
SELECT epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS ts_us,
       count(*) FILTER (WHERE post_status = 'publish') AS published, count(*) AS total FROM i""",
    i=INCIDENTS))
def s18(spark, sf):
    m = sinks.run_metrics(AS_OF, published=F.count_if(F.col("post_status") == "publish"),
                          total=F.count("*"))
    return incidents(spark, sf).agg(*[F.first(m[0]).alias("ts"), *m[1:]]).select(
        F.unix_micros("ts").alias("ts_us"), "published", "total")


@query("s19_purge_by_type", """
SELECT record_type, post_status, count(*) AS n FROM (
  SELECT o_orderstatus AS record_type, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'trash'
         ELSE 'publish' END AS post_status FROM orders) GROUP BY 1, 2""")
def s19(spark, sf):
    posts = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("record_type"),
                                              F.lit("publish").alias("post_status"))
    return moderation.purge(posts, ["F", "P"]).groupBy("record_type", "post_status").agg(
        F.count("*").alias("n"))


@query("s19_purge_by_type_hard", """
SELECT o_orderkey AS post_id FROM orders WHERE o_orderstatus NOT IN ('F', 'P')""")
def s19_hard(spark, sf):
    posts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"),
                                              F.col("o_orderstatus").alias("record_type"))
    return moderation.purge(posts, ["F", "P"], force=True).select("post_id")


@query("s20_label_bridge", """
SELECT 'customer' AS record_type, c_custkey AS record_id, n_name AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def s20(spark, sf):
    c = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sinks.label_bridge(c, "c_custkey", "n_name", "customer")


@query("s20_labels_to_seed", """
SELECT DISTINCT n_name AS label FROM nation WHERE n_nationkey NOT IN
  (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000)""")
def s20_seed(spark, sf):
    n = table(spark, sf, "nation")
    wanted = n.select(F.col("n_name").alias("label"))
    rich = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 8000")
    stored = rich.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("label")).distinct()
    return sinks.missing_labels(wanted, stored)


@query("p01_payload_caps", with_views("""
SELECT article_id, substring(title, 1, 200) AS title, substring(content, 1, 4000) AS content FROM a""",
    a=ARTICLES))
def p01(spark, sf):
    return landed.payload(articles(spark, sf)).select("article_id", "title", "content")


@query("p25_missing_title_rejects", """
SELECT conv_id, turn, 'missing title' AS reject_reason FROM conversations
WHERE trim(CASE WHEN role = 'user' THEN text ELSE '' END) = ''""")
def p25(spark, sf):
    c = table(spark, sf, "conversations").withColumn(
        "title", F.when(F.col("role") == "user", F.col("text")).otherwise(""))
    return dedupe.rejects(c).select("conv_id", "turn", "reject_reason")


@query("p27_missing_link_drop", """
SELECT page_id FROM pages WHERE length(regexp_extract(url, '#(.*)$', 1)) > 0""")
def p27(spark, sf):
    p = table(spark, sf, "pages").withColumn("link", F.regexp_extract("url", "#(.*)$", 1))
    return dedupe.required(p, "link").select("page_id")


_HAZARD, _PLACE = ["heat", "onst", "nicht"], ["than", "elle", "erin"]


@query("p15_post_search", f"""
SELECT doc_id FROM documents WHERE lang = 'en' AND {d_any("lower(text)", _HAZARD)}
  AND {d_any("lower(text)", _PLACE)} AND NOT starts_with(text, 'The') AND NOT contains(text, '|')""")
def p15(spark, sf):
    posts = table(spark, sf, "documents").withColumns({
        "is_retweet": F.startswith("text", F.lit("The")),
        "is_reply": F.contains("text", F.lit("|"))})
    return landed.search_posts(posts, _HAZARD, _PLACE).select("doc_id")


@query("p16_country_keyword_filter", with_views("""
SELECT article_id FROM a WHERE contains(lower(title), 'than') OR contains(lower(source), 'src1')""",
    a=ARTICLES))
def p16(spark, sf):
    return landed.mentions_any(articles(spark, sf), {"title": "Than", "source": "SRC1"}).select(
        "article_id")


@query("s09_social_articles", """
SELECT 'https://twitter.com/' || source || '/status/' || doc_id AS url,
       substring(text, 1, 120) AS title, length(text) AS n_text, 'x.com/@' || source AS source
FROM documents""", longs=True)
def s09(spark, sf):
    posts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("handle"),
        F.lit("twitter").alias("platform"), "text", F.lit(AS_OF).cast("timestamp")
        .alias("created_at"))
    return landed.social_articles(posts).select("url", "title", F.length("content").alias("n_text"),
                                                "source")


@query("j06_posts_with_authors", """
SELECT doc_id, coalesce(c_name, 'unknown') AS username
FROM documents LEFT JOIN customer ON doc_id * 2 = c_custkey""")
def j06(spark, sf):
    posts = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 2)
                                                 .alias("author_id"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                F.col("c_name").alias("username"))
    return landed.with_authors(posts, users).select("doc_id", "username")


@query("w04_newest_updates_per_incident", with_views("""
SELECT incident_id, update_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, update_id DESC)
    AS rank FROM u WHERE status = 'publish') WHERE rank <= 2""", u=UPDATES))
def w04(spark, sf):
    from newsgrid.operators.lifecycle import newest_updates
    return newest_updates(updates(spark, sf), 2).select("incident_id", "update_id", "rank")


@query("j05_incidents_with_updates", with_views("""
SELECT i.incident_id, coalesce(x.ids, '') AS update_ids FROM i LEFT JOIN (
  SELECT incident_id, string_agg(CAST(update_id AS VARCHAR), ',' ORDER BY created_at DESC,
         update_id DESC) AS ids
  FROM (SELECT * FROM u WHERE status = 'publish' QUALIFY row_number() OVER (
          PARTITION BY incident_id ORDER BY created_at DESC, update_id DESC) <= 25)
  GROUP BY incident_id) x ON i.incident_id = x.incident_id""", i=INCIDENTS, u=UPDATES))
def j05(spark, sf):
    from newsgrid.operators.lifecycle import incidents_with_updates
    out = incidents_with_updates(incidents(spark, sf), updates(spark, sf))
    return out.select("incident_id", F.array_join(F.transform(
        "updates", lambda u: u["update_id"].cast("string")), ",").alias("update_ids"))


@query("s11_reference_tables", """
SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def s11(spark, sf):
    """Nested reference rows; the group is a short administrative list."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"),
                                        F.col("n_regionkey") == F.col("r_regionkey"))
    return county_table(n, "r_name", "n_name").select(
        F.col("name").alias("region"),
        F.array_join(F.transform("subs", lambda s: s["name"]), ",").alias("nations"))


@query("j18_updates_with_parent_title", with_views("""
SELECT u.update_id, i.title AS incident_title FROM u LEFT JOIN (
  SELECT * FROM i WHERE post_status = 'pending') i ON u.incident_id = i.incident_id""",
    u=UPDATES, i=INCIDENTS))
def j18(spark, sf):
    parents = incidents(spark, sf).filter(F.col("post_status") == "pending")
    return moderation.updates_with_parent(updates(spark, sf), parents).select(
        "update_id", "incident_title")


@query("x11_keyed_default_merge", """
SELECT o_orderkey AS incident_id, coalesce(nullif(o_orderpriority, '1-URGENT'), 'fire') AS type,
       'unsafe' AS status FROM orders""")
def x11(spark, sf):
    o = table(spark, sf, "orders")
    stored = F.when(F.col("o_orderpriority") != "1-URGENT", F.create_map(
        F.lit("type"), F.col("o_orderpriority"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = arrays.merge_defaults(stored, {"type": "fire", "status": "unsafe"})
    return o.select(F.col("o_orderkey").alias("incident_id"), merged["type"].alias("type"),
                    merged["status"].alias("status"))


@query("x10_slug_to_subs_map", """
SELECT regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') AS slug, count(*) AS n_subs,
       min(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g')) AS first_sub
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def x10(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"),
                                        F.col("n_regionkey") == F.col("r_regionkey"))
    tree = county_tree(county_table(n, "r_name", "n_name"))
    return tree.select("slug", F.size("subs").cast("long").alias("n_subs"),
                       F.array_min(F.transform("subs", lambda s: s["slug"])).alias("first_sub"))
