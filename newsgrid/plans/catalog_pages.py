"""Raw pages, feeds, advisories, and the ingest run end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import html as hx
from newsgrid.functions.text import strip_tags
from newsgrid.functions.udfs import page_body_udf
from newsgrid.plans import ingest
from newsgrid.plans.bindings import (
    ARTICLE_WORDS, ARTICLES, AS_OF, GAZETTEER, INCIDENT_WORDS, PLACES, SEEN, STORE, TITLE_STOPS,
    d_tokens, places, plain, table, values_sql, view, with_views,
)
from newsgrid.plans.catalog_counts import heavy_articles as articles
from newsgrid.plans.catalog_incidents import _match_sql
from newsgrid.plans.catalog_text import (
    _PARTS_TEXT, _class_sql, _gate_sql, _place_sql, text_parts,
)
from newsgrid.plans.registry import query
from newsgrid.session import cut_lineage, dealt
from newsgrid.sources import feeds, landed, pages as pg


def raw_pages(spark, sf):
    return dealt(table(spark, sf, "pages"))


def _text_sql(html: str) -> str:
    """Visible text: scripts, styles, comments and tags out, references decoded."""
    out = f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b.*?</style\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_TITLE = _text_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
_BODY = _text_sql("regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)")
_HOST = "regexp_extract(url, '^https?://(?:www\\.)?([^/?#]+)', 1)"


@query("c25_extract_pages", f"""
SELECT page_id, {_TITLE} AS title, '' AS excerpt, md5({_BODY}) AS body_hash, {_HOST} AS source,
       epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS published_us
FROM pages WHERE {_TITLE} <> ''""")
def c25(spark, sf):
    return pg.extract_pages(raw_pages(spark, sf), AS_OF).select(
        "page_id", "title", "excerpt", F.md5("content").alias("body_hash"), "source",
        F.unix_micros("published_at").alias("published_us"))


@query("s05_page_scan", f"""
SELECT page_id, length({_BODY}) AS n_body FROM pages""", longs=True)
def s05(spark, sf):
    return pg.extract_pages(raw_pages(spark, sf), AS_OF, ["div.none", "article"]).select(
        "page_id", F.length("content").alias("n_body"))


@query("t11_tag_stripping", f"SELECT page_id, md5({_text_sql('html')}) AS h FROM pages")
def t11(spark, sf):
    return raw_pages(spark, sf).select("page_id", F.md5(strip_tags(F.col("html"))).alias("h"))


# Pages whose head also carries metadata, built from the page itself.
_RICH = """
SELECT page_id, url, concat('<html><head>', CASE WHEN page_id % 2 = 0 THEN concat(
    '<meta property="og:title" content="Shared ', CAST(page_id AS VARCHAR(20)), '">') ELSE '' END,
  CASE page_id % 3 WHEN 0 THEN concat('<meta name="description" content="About ',
    CAST(page_id AS VARCHAR(20)), ' &amp; more">') WHEN 1 THEN concat(
    '<meta content="Open ', CAST(page_id AS VARCHAR(20)), '" property="og:description">') ELSE '' END,
  CASE page_id % 4 WHEN 0 THEN concat('<script type="application/ld+json">[#"datePublished": "2024-01-05T10:00:00Z"~]</script>')
    WHEN 1 THEN '<meta name="pubdate" content="2024-01-06T11:00:00Z">' ELSE '' END, '</head>', html,
  CASE page_id % 4 WHEN 2 THEN '<time class="x" datetime="2024-01-07T12:00:00Z">then</time>' ELSE '' END)
  AS html
FROM {pages}
""".replace("[#", "', chr(91), chr(123), '").replace("~]", "', chr(125), chr(93), '")


@query("t20_page_title", with_views(f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Shared ' || page_id ELSE {_TITLE} END AS title
FROM r""", r=_RICH))
def t20(spark, sf):
    return view(spark, sf, _RICH).select("page_id", hx.page_title(F.col("html")).alias("title"))


@query("t21_page_excerpt", with_views("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'About ' || page_id || ' & more' WHEN 1 THEN
  'Open ' || page_id ELSE '' END AS excerpt FROM r""", r=_RICH))
def t21(spark, sf):
    return view(spark, sf, _RICH).select("page_id", hx.page_excerpt(F.col("html"))
                                         .alias("excerpt"))


@query("t22_page_date", with_views("""
SELECT page_id, epoch_us(CASE page_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-05 10:00:00'
  WHEN 1 THEN TIMESTAMP '2024-01-06 11:00:00' WHEN 2 THEN TIMESTAMP '2024-01-07 12:00:00'
  ELSE TIMESTAMP '2024-01-31 00:00:00' END) AS us FROM r""", r=_RICH))
def t22(spark, sf):
    return view(spark, sf, _RICH).select("page_id", F.unix_micros(hx.page_published(
        F.col("html"), AS_OF)).alias("us"))


@query("t23_page_body", f"SELECT page_id, md5({_BODY}) AS h FROM pages")
def t23(spark, sf):
    """The article sits inside nested containers of its own kind."""
    wrapped = F.concat(F.lit('<div class="a story-body b"><div>'), F.regexp_extract(
        "html", r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1), F.lit("</div></div><div>x</div>"))
    return raw_pages(spark, sf).select("page_id", F.md5(hx.page_body(wrapped)).alias("h"))


_HREF = """string_split(string_split(a, 'href="')[2], '"')[1]"""
_LINKS = f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, {_HREF} AS href, {_text_sql('a')} AS label, url
FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS pos
      FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a\\s*>')
              AS l FROM pages))"""


@query("t24_page_links", f"""
SELECT page_id, pos, label FROM ({_LINKS}) WHERE href <> ''""")
def t24(spark, sf):
    return pg.page_link_rows(raw_pages(spark, sf)).select("page_id", "pos", "label")


@query("t24_page_links_by_pattern", f"""
SELECT page_id, pos, label FROM ({_LINKS}) WHERE regexp_matches(href, 'th') AND length(label) > 8""")
def t24_pattern(spark, sf):
    return pg.page_link_rows(raw_pages(spark, sf), "th", 8).select("page_id", "pos", "label")


@query("t25_absolute_links", f"""
SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS url
FROM ({_LINKS}) WHERE starts_with(href, '/')""")
def t25(spark, sf):
    return pg.page_link_rows(raw_pages(spark, sf)).select("page_id", "pos", "url")


# Feed items written from the documents, titles being whole first lines: Atom for every third, RSS for the rest.
def _items(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source", F.replace(F.replace(F.replace(
            F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("&"), F.lit("&amp;")),
            F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("t"))
    key = F.col("doc_id").cast("string")
    atom = F.concat(F.lit('<entry><link href="https://f.example/'), key, F.lit('"/><title>'), "t",
                    F.lit("</title><summary>"), "source",
                    F.lit("</summary><published>2024-01-05T10:00:00Z</published></entry>"))
    rss = F.concat(F.lit("<item><link>https://f.example/"), key, F.lit("</link><title>"), "t",
                   F.lit("</title><description>"), "source", F.lit("</description><pubDate>"),
                   F.lit("Fri, 05 Jan 2024 11:00:00 GMT</pubDate></item>"))
    bare = F.concat(F.lit("<item><title>"), "t", F.lit("</title></item>"))
    kind = F.col("doc_id") % 3
    return d.select("doc_id", F.when(kind == 0, atom).when(kind == 1, rss).otherwise(bare)
                    .alias("xml"))


@query("s04_feed_items", """
SELECT doc_id, 'https://f.example/' || doc_id AS url,
       CASE WHEN trim(t) = '' THEN '(untitled)' ELSE trim(t) END AS title, source AS content,
       epoch_us(CASE doc_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-05 10:00:00'
                ELSE TIMESTAMP '2024-01-05 11:00:00' END) AS us
FROM (SELECT *, split_part(text, chr(10), 1) AS t FROM documents)
WHERE doc_id % 3 <> 2""")
def s04(spark, sf):
    out = feeds.feed_articles(feeds.parse_items(_items(spark, sf)), AS_OF, "feed")
    return out.select("doc_id", "url", "title", "content", F.unix_micros("published_at")
                      .alias("us"))


@query("s06_nested_advisory_documents", f"""
SELECT conv_id, turn, {_PARTS_TEXT} AS h, 'talk ' || role AS excerpt
FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations)""")
def s06(spark, sf):
    docs = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(
        F.concat(F.lit("talk "), "role").alias("description"),
        F.struct(text_parts().alias("parts")).alias("details"))).alias("json"))
    return landed.advisory_documents(docs, AS_OF).select(
        "conv_id", "turn", F.md5("content").alias("h"), "excerpt")


_RULES = [
    pg.AdvisoryRule("en", "Office A: Travel", level=("div.none", "div.ad"), body=("article",),
                    level_max=30),
    pg.AdvisoryRule("fr", "Office B: Travel", level=("div.ad",), body=("main", "article"),
                    level_shorter_than=45, excerpt_from_body=True),
    pg.AdvisoryRule("de", "Office C: Travel", body=("article",), level_pattern=r"(ad \d|t[ie]n)"),
    pg.AdvisoryRule("es", "Office D: Travel", body=("#none", "article"), dated="reissued"),
]
_BADGE = _text_sql("regexp_extract(html, '(?is)<div class=\"ad\">(.*?)</div>', 1)")
_LANG = "regexp_extract(html, '<html lang=\"(\\w+)\"', 1)"


@query("s07_advisory_pages", f"""
SELECT page_id, issuer AS source, md5({_BODY}) AS body_hash,
  CASE issuer WHEN 'en' THEN 'Office A: Travel' || CASE WHEN {_BADGE} <> '' THEN ' — ' ||
                   substring({_BADGE}, 1, 30) ELSE '' END
    WHEN 'fr' THEN 'Office B: Travel' || CASE WHEN {_BADGE} <> '' AND length({_BADGE}) < 45
                   THEN ' — ' || {_BADGE} ELSE '' END
    WHEN 'de' THEN 'Office C: Travel' || CASE WHEN lv <> '' THEN ' — ' || lv ELSE '' END
    ELSE 'Office D: Travel' END AS title,
  CASE issuer WHEN 'fr' THEN substring({_BODY}, 1, 280) ELSE '' END AS excerpt
FROM (SELECT *, {_LANG} AS issuer, regexp_extract({_text_sql('html')}, '(ad \\d|t[ie]n)', 1) AS lv
      FROM pages) WHERE issuer IN ('en', 'fr', 'de', 'es')""")
def s07(spark, sf):
    p = raw_pages(spark, sf).withColumn("issuer", F.regexp_extract(
        "html", r'<html lang="(\w+)"', 1))
    return pg.advisory_pages(p, _RULES, AS_OF).select(
        "page_id", "source", "title", "excerpt", F.md5("content").alias("body_hash"))


@query("s08_search_feed_articles", """
SELECT 'https://g.example/' || doc_id AS url, split_part(text, chr(10), 1) AS title,
       substring(""" + _text_sql("text || ' <b>' || lang || '</b> - &amp; x'") + """, 1, 280) AS excerpt,
       'News search (' || source || ')' AS source FROM documents""")
def s08(spark, sf):
    """Titles are first lines, with inner dashes; summaries have tags and references."""
    d = table(spark, sf, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    items = d.select(
        F.concat(F.lit("https://g.example/"), F.col("doc_id").cast("string")).alias("link"),
        F.concat(first, F.lit(" - "), "source").alias("title"),
        F.concat("text", F.lit(" <b>"), "lang", F.lit("</b> - &amp; x")).alias("summary"),
        F.lit("").alias("published"))
    return landed.search_feed_articles(items, AS_OF).select("url", "title", "excerpt", "source")


# -- the ingest run -----------------------------------------------------------------

def _run(spark, sf, **options):
    a = articles(spark, sf).drop("sentiment")
    have = table(spark, sf, "customer").select(
        F.concat(F.lit("https://news.example/"), F.md5("c_name")).alias("source_url"),
        F.lit("publish").alias("post_status"))
    return ingest.run_ingest(
        a, view(spark, sf, STORE), have, view(spark, sf, SEEN), ARTICLE_WORDS, INCIDENT_WORDS,
        GAZETTEER, places(spark), AS_OF, [F.asc("article_id")], stop_words=TITLE_STOPS, **options)


_FRESH = f"""SELECT *, {d_tokens('t')} AS tt, {d_tokens('b')} AS bt FROM (
  SELECT *, lower(title) AS t, lower(content) AS b FROM (
    SELECT * FROM all_a QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id) = 1)
  WHERE url NOT IN (SELECT url FROM s))"""
_CANDIDATE_PLACES = f"""
SELECT article_id, word AS name, p.lat FROM (
  SELECT article_id, unnest(c) AS word, generate_subscripts(c, 1) AS pos
  FROM (SELECT article_id, {_place_sql('title')} AS c FROM a)) c
JOIN ({values_sql(PLACES)}) AS p(name, lat, lng) ON lower(c.word) = p.name
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY pos) = 1"""
# Gated, classified, located and routed; the flags text is that of the keyword record.
_INCIDENT_ROWS = f"""
SELECT a.article_id, a.url, c.type, c.severity, c.confidence,
       coalesce(m.name, f.name, 'Kenya') AS location_name,
       coalesce(m.specificity, CASE WHEN f.name IS NOT NULL THEN 1 ELSE 0 END) AS spec,
       concat_ws('; ', CASE WHEN c.confidence < 0.60 THEN 'low classification confidence ('
                            || printf('%.2f', c.confidence) || ')' END,
         CASE WHEN coalesce(m.specificity, 0) <= 1 THEN 'imprecise location ('
              || coalesce(m.name, f.name, 'Kenya') || ')' END,
         'LLM unavailable — keyword fallback used') AS review_reason
FROM a JOIN ({_class_sql()}) c ON a.article_id = c.article_id
LEFT JOIN ({_match_sql("title || '  ' || content")}) m ON a.article_id = m.article_id
LEFT JOIN ({_CANDIDATE_PLACES}) f ON a.article_id = f.article_id
WHERE {_gate_sql()}"""


def _chain(sql: str) -> str:
    return (f"WITH all_a AS ({plain(ARTICLES)}), s AS ({plain(SEEN)}), st AS ({plain(STORE)}), "
            f"a AS ({_FRESH}) " + sql)


@query("c15_incident_ingest_incidents", _chain(f"""
SELECT article_id, type, severity, confidence, location_name, review_reason,
       'pending' AS post_status, false AS is_verified FROM ({_INCIDENT_ROWS})"""))
def c15_incidents(spark, sf):
    return _run(spark, sf, keep_incidents=cut_lineage).incidents().select(
        "article_id", "type", "severity", "confidence", "location_name", "review_reason",
        "post_status", "is_verified")


@query("c15_incident_ingest_articles", _chain("""
SELECT article_id, url FROM a WHERE url NOT IN (SELECT url FROM st WHERE post_status = 'publish')"""))
def c15_articles(spark, sf):
    return _run(spark, sf).articles().select("article_id", "url")


@query("c15_incident_ingest_funnel", _chain(f"""
SELECT source, count(*) AS seen, count(*) - count(o) AS already_seen,
       count(*) FILTER (WHERE o = 'dropped') AS prefilter_dropped,
       count(*) FILTER (WHERE o IN ('incident', 'rejected')) AS scorer_checked,
       count(*) FILTER (WHERE o = 'rejected') AS scorer_rejected,
       count(*) FILTER (WHERE o = 'incident') AS incidents
FROM all_a LEFT JOIN (
  SELECT a.article_id, CASE WHEN NOT ({_gate_sql()}) THEN 'dropped'
           WHEN i.article_id IS NOT NULL THEN 'incident' ELSE 'rejected' END AS o
  FROM a LEFT JOIN ({_INCIDENT_ROWS}) i ON a.article_id = i.article_id) x
  ON all_a.article_id = x.article_id
GROUP BY source"""))
def c15_funnel(spark, sf):
    return _run(spark, sf).funnel()


@query("c15_incident_ingest_seen", _chain("SELECT url FROM a"))
def c15_seen(spark, sf):
    return _run(spark, sf).seen().select("url")


@query("v03_page_body_udf", f"SELECT page_id, md5({_BODY}) AS h FROM pages")
def v03(spark, sf):
    """The page body through an HTML parser instead of expressions."""
    body = page_body_udf(hx.DEFAULT_CONTAINERS)
    return raw_pages(spark, sf).select("page_id", F.md5(body("html")).alias("h"))
