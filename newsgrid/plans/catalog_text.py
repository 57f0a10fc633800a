"""Term counting, enrichment, the incident gate and classifier, the scorer shell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from newsgrid.functions import arrays, numbers, text as tx
from newsgrid.functions.records import (
    coerce_assessment, joined_parts, loose_object, parse_entities,
)
from newsgrid.operators import classify as cl, enrich, lexicon as lx, moderation
from newsgrid.plans.bindings import (
    ARTICLE_WORDS as AW, ARTICLES, AS_OF, INCIDENT_WORDS as IW, INCIDENTS, TITLE_STOPS, d_any,
    d_ascii, d_distinct, d_substrs, d_terms, d_tokens, d_words, quoted, small_table, table, values_sql,
    view, with_views,
)
from newsgrid.plans.catalog_counts import _topic_counts_sql, heavy_articles as articles, incidents
from newsgrid.plans.registry import query
from newsgrid.session import dealt


def docs(spark, sf):
    return dealt(table(spark, sf, "documents"))


def low():
    return F.lower("text")


@query("t01_whole_word_count", f"""
SELECT doc_id, {d_words(d_tokens('lower(text)'), ['than'])} AS n FROM documents""", longs=True)
def t01(spark, sf):
    return docs(spark, sf).select("doc_id", tx.word_count(low(), "than").alias("n"))


@query("t02_substring_count", f"""
SELECT doc_id, {d_substrs('lower(text)', ['tion'])} AS n FROM documents""", longs=True)
def t02(spark, sf):
    return docs(spark, sf).select("doc_id", tx.substring_count(low(), F.lit("tion")).alias("n"))


_SOME = ["license", "nicht", "apache", "edouhe", "reedes"]


@query("t03_any_substring", f"""
SELECT doc_id FROM documents WHERE {d_any('lower(text)', _SOME)}""")
def t03(spark, sf):
    return docs(spark, sf).filter(tx.contains_any(low(), _SOME)).select("doc_id")


@query("t04_distinct_phrase_count", f"""
SELECT doc_id, {d_distinct('lower(text)', _SOME)} AS n FROM documents""")
def t04(spark, sf):
    return docs(spark, sf).select("doc_id", tx.distinct_contained(low(), _SOME).alias("n"))


@query("t05_metaphor_stripping", """
SELECT doc_id, md5(replace(replace(lower(text), 'of the', ' '), 'tion', ' ')) AS h FROM documents""")
def t05(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.blank_out(low(), ["of the", "tion"]))
                                  .alias("h"))


_SPANS = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"


@query("t06_capitalised_spans", f"""
SELECT doc_id, array_to_string(regexp_extract_all({d_ascii('text')}, '{_SPANS}'), '|') AS spans
FROM documents""")
def t06(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tx.capitalised_spans(F.col("text")), "|")
                                  .alias("spans"))


def _place_sql(text: str) -> str:
    multi = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:,\s*[A-Z][a-z]+)*\b"
    single = r"\b[A-Z][a-z]{3,}\b"
    both = (f"regexp_extract_all({d_ascii(text)}, '{multi}') || list_filter(regexp_extract_all("
            f"{d_ascii(text)}, '{single}'), lambda w: w NOT IN ({quoted(TITLE_STOPS)}))")
    return f"""list_transform(list_filter(list_transform(range(1, len({both}) + 1),
        lambda i: struct_pack(v := ({both})[i], i := i)), lambda x: list_position(
        list_transform({both}, lambda y: lower(y)), lower(x.v)) = x.i), lambda x: x.v)"""


@query("t07_title_place_candidates", f"""
SELECT doc_id, array_to_string({_place_sql('text')}, '|') AS candidates
FROM documents""")
def t07(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tx.title_place_candidates(
        F.col("text"), TITLE_STOPS), "|").alias("candidates"))


_TOKENS = f"regexp_extract_all({d_ascii('lower(text)')}, '\\b[a-z]{{4,}}\\b')"


@query("t08_lower_tokens", f"""
SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string({_TOKENS}, ' ')) AS h FROM documents""", longs=True)
def t08(spark, sf):
    t = tx.lower_tokens(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " "))
                                  .alias("h"))


@query("t09_stop_word_removal", f"""
SELECT doc_id, md5(array_to_string(list_filter({_TOKENS}, lambda w: w NOT IN ({quoted(AW.stop)})),
       ' ')) AS h FROM documents""")
def t09(spark, sf):
    t = tx.without_words(tx.lower_tokens(F.col("text")), AW.stop)
    return docs(spark, sf).select("doc_id", F.md5(F.array_join(t, " ")).alias("h"))


@query("t10_truncation", """
SELECT doc_id, length(substring(text, 1, 300)) AS n300, md5(substring(text, 1, 1500)) AS h1500
FROM documents""", longs=True)
def t10(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(tx.truncate(F.col("text"), 300)).alias("n300"),
                                  F.md5(tx.truncate(F.col("text"), 1500)).alias("h1500"))


@query("t12_whitespace_collapse", r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents""")
def t12(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("h"))


# Hints built from the documents: an opener, a place word, a marker and another word.
_HINT = """
SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'At the ' WHEN 1 THEN 'near ' WHEN 2 THEN ''
         WHEN 3 THEN 'in ' ELSE 'outside ' END, lang, CASE doc_id % 3 WHEN 0 THEN ' junction of '
         WHEN 1 THEN ' near ' ELSE ' ' END, source, ', ') AS hint FROM {documents}
"""


@query("t14_place_hint_variants", with_views(r"""
SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda x: x <> ''), '|') AS variants
FROM (SELECT doc_id, list_filter(list_transform(range(1, len(l) + 1), lambda i:
               CASE WHEN list_position(l, l[i]) = i THEN l[i] ELSE '' END), lambda x: x <> '')
             AS list_distinct_ordered
      FROM (SELECT doc_id, [raw, c,
              CASE WHEN contains(lower(c), 'junction of ') THEN
                trim(substring(c, position('junction of ' IN lower(c)) + 12), ' ,.-') ELSE '' END,
              CASE WHEN contains(lower(c), 'near ') THEN
                trim(substring(c, position('near ' IN lower(c)) + 5), ' ,.-') ELSE '' END] AS l
            FROM (SELECT doc_id, trim(hint) AS raw,
                    CASE WHEN regexp_matches(trim(hint), '(?i)^(at the|at|in the|in|near the|near|outside) ')
                      THEN trim(regexp_replace(trim(hint),
                           '(?i)^(at the|at|in the|in|near the|near|outside) ', ''), ' ,.-')
                      ELSE trim(hint) END AS c FROM h)))""", h=_HINT))
def t14(spark, sf):
    return view(spark, sf, _HINT).select("doc_id", F.array_join(
        tx.place_hint_variants(F.col("hint")), "|").alias("variants"))


@query("t15_slugify", """
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')
  AS slug FROM documents""")
def t15(spark, sf):
    return docs(spark, sf).select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("t16_first_words", r"""
SELECT doc_id, array_to_string(w[1:10], ' ') || CASE WHEN len(w) > 10 THEN '…' ELSE '' END AS lead
FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w
      FROM documents)""")
def t16(spark, sf):
    return docs(spark, sf).select("doc_id", tx.first_words(F.col("text"), 10).alias("lead"))


@query("t17_address_hash", """
SELECT c_custkey, sha256(c_name || 'pepper') AS h FROM customer""")
def t17(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", tx.address_hash(F.col("c_name"), "pepper").alias("h"))


_TITLED = "concat(text, CASE WHEN doc_id % 4 <> 0 THEN ' - ' || lang ELSE '' END, " \
          "CASE WHEN doc_id % 3 = 0 THEN ' - ' || source ELSE '' END)"


@query("t26_headline_and_publisher", f"""
SELECT doc_id, CASE WHEN contains(t, ' - ') THEN regexp_extract(t, '(?s)^(.*) - (.*)$', 1) ELSE t END
         AS headline,
       CASE WHEN contains(t, ' - ') THEN regexp_extract(t, '(?s)^(.*) - (.*)$', 2) ELSE 'Unknown' END
         AS publisher
FROM (SELECT doc_id, {_TITLED} AS t FROM documents)""")
def t26(spark, sf):
    d = docs(spark, sf).withColumn("t", F.expr(_TITLED))
    return d.select("doc_id", tx.headline_of(F.col("t")).alias("headline"),
                    tx.publisher_of(F.col("t")).alias("publisher"))


@query("t27_profile_url", """
SELECT c_custkey, CASE c_mktsegment
  WHEN 'BUILDING' THEN 'https://twitter.com/' || replace(c_name, '#', '%23')
  WHEN 'MACHINERY' THEN 'https://www.facebook.com/profile.php?id=' || c_custkey
  WHEN 'HOUSEHOLD' THEN 'https://www.facebook.com/' || replace(c_name, '#', '%23')
  WHEN 'FURNITURE' THEN 'https://www.youtube.com/channel/' || replace(c_name, '#', '%23')
  ELSE '' END AS url FROM customer""")
def t27(spark, sf):
    seg = F.col("c_mktsegment")
    platform = (F.when(seg == "BUILDING", "x").when(seg.isin("MACHINERY", "HOUSEHOLD"), "facebook")
                .when(seg == "FURNITURE", "youtube").otherwise("radio"))
    handle = F.when(seg == "MACHINERY", F.col("c_custkey").cast("string")).otherwise(
        F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", tx.profile_url(platform, handle)
                                               .alias("url"))


@query("t28_source_labels", """
SELECT doc_id, 'News search (' || source || ')' AS search_label,
       CASE lang WHEN 'en' THEN 'x.com/@' || source ELSE lang || '.com/' || source END AS social_label
FROM documents""")
def t28(spark, sf):
    platform = F.when(F.col("lang") == "en", "twitter").otherwise(F.col("lang"))
    return docs(spark, sf).select(
        "doc_id", tx.search_feed_label(F.col("source")).alias("search_label"),
        tx.social_label(platform, F.col("source")).alias("social_label"))


@query("t29_level_suffix", r"""
SELECT doc_id, text || CASE WHEN b <> '' AND length(b) < 60 THEN ' — ' || b ELSE ''
         END AS title,
       text || CASE WHEN b <> '' THEN ' — ' || substring(b, 1, 40) ELSE '' END AS cut
FROM (SELECT doc_id, text, trim(regexp_extract(text, '^([^.\n]*)\.', 1)) AS b FROM documents)""")
def t29(spark, sf):
    badge = F.regexp_extract("text", r"^([^.\n]*)\.", 1)
    title = F.col("text")
    return docs(spark, sf).select("doc_id", tx.with_level(title, badge, shorter_than=60)
                                  .alias("title"), tx.with_level(title, badge, 40).alias("cut"))


@query("t30_place_label", """
SELECT c_custkey, concat_ws(', ', nullif(c_mktsegment, 'BUILDING'), n_name, r_name) AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def t30(spark, sf):
    c = (table(spark, sf, "customer")
         .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    part = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", tx.place_label(part, F.col("n_name"), F.col("r_name"))
                    .alias("label"))


# -- enrichment -------------------------------------------------------------------

_TEXT = "trim(title || chr(10) || content)"


def _valence_rows() -> str:
    return values_sql(list(AW.valence.items()))


@query("c02_sentiment", with_views(f"""
SELECT article_id, round(s / sqrt(s * s + 15), 6) AS score,
       CASE WHEN s / sqrt(s * s + 15) >= 0.15 THEN 'positive'
            WHEN s / sqrt(s * s + 15) <= -0.15 THEN 'negative' ELSE 'neutral' END AS label
FROM (SELECT article_id, coalesce(sum(v.val), 0.0) AS s
      FROM (SELECT article_id, unnest({d_tokens('lower(' + _TEXT + ')')} || ['']) AS w FROM a) t
      LEFT JOIN ({_valence_rows()}) AS v(word, val) ON t.w = v.word GROUP BY article_id)""",
    a=ARTICLES))
def c02(spark, sf):
    score = enrich.sentiment_score(enrich.article_text(F.col("title"), F.col("content")),
                                   AW.valence)
    return (articles(spark, sf).select("article_id", score.alias("s"))
            .select("article_id", F.round("s", 6).alias("score"),
                    enrich.sentiment_label(F.col("s")).alias("label")))


@query("c03_bias_score", with_views(f"""
SELECT article_id, greatest(-100, least(100, bias_baseline + greatest(-25, least(25, 3 * (
         {d_substrs('low', AW.right)} - {d_substrs('low', AW.left)}))))) AS bias
FROM (SELECT *, lower({_TEXT}) AS low FROM a)""", a=ARTICLES), longs=True)
def c03(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select("article_id", enrich.bias_score(
        text, F.col("bias_baseline"), AW.left, AW.right).alias("bias"))


@query("c04_topics", with_views(f"""
SELECT a.article_id, coalesce(t.topics, '') AS topics FROM a LEFT JOIN (
  SELECT article_id, string_agg(topic, ',' ORDER BY rk) AS topics FROM ({_topic_counts_sql()})
  WHERE rk <= 4 GROUP BY article_id) t ON a.article_id = t.article_id""", a=ARTICLES))
def c04(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select("article_id", F.array_join(
        enrich.topics(text, AW.topics), ",").alias("topics"))


_ENTS = f"""
SELECT article_id, string_agg(s, '|' ORDER BY pos) AS persons FROM (
  SELECT article_id, s, min(pos) AS pos, row_number() OVER (PARTITION BY article_id ORDER BY min(pos))
    AS rk
  FROM (SELECT article_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (
          SELECT article_id, regexp_extract_all({d_ascii(_TEXT)}, '{_SPANS}') AS l FROM a))
  WHERE lower(s) NOT IN ({quoted(AW.stop)}) GROUP BY article_id, s)
WHERE rk <= 10 GROUP BY article_id"""


@query("c05_entities", with_views(f"""
SELECT a.article_id, coalesce(e.persons, '') AS persons FROM a LEFT JOIN ({_ENTS}) e
  ON a.article_id = e.article_id""", a=ARTICLES))
def c05(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select("article_id", F.array_join(
        enrich.entities(text, AW.stop)["persons"], "|").alias("persons"))


_RANKED_WORDS = f"""
SELECT article_id, w, n, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, pos) AS rk FROM (
  SELECT article_id, w, count(*) AS n, min(pos) AS pos FROM (
    SELECT article_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (
      SELECT article_id, regexp_extract_all({d_ascii('lower(' + _TEXT + ')')}, '\\b[a-z]{{4,}}\\b') AS l
      FROM a)) GROUP BY article_id, w)"""
_KEYWORDS = f"""
SELECT article_id, string_agg(w, ',' ORDER BY rk) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY rk) AS k FROM ({_RANKED_WORDS})
  WHERE rk <= 30 AND w NOT IN ({quoted(AW.stop)})) WHERE k <= 5 GROUP BY article_id"""


@query("c06_keywords", with_views(f"""
SELECT a.article_id, coalesce(k.keywords, '') AS keywords FROM a LEFT JOIN ({_KEYWORDS}) k
  ON a.article_id = k.article_id""", a=ARTICLES))
def c06(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select("article_id", F.array_join(
        enrich.keywords(text, AW.stop), ",").alias("keywords"))


@query("a19_keyword_frequency", with_views(f"""
SELECT article_id, w AS word, n FROM ({_RANKED_WORDS}) WHERE rk <= 5""", a=ARTICLES), longs=True)
def a19(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    ranked = tx.ranked_tokens(tx.lower_tokens(text))
    return (articles(spark, sf).select("article_id", F.explode(F.slice(ranked, 1, 5)).alias("r"))
            .select("article_id", F.col("r.word").alias("word"), (-F.col("r.neg")).alias("n")))


@query("w06_top_terms_per_document", with_views(f"""
SELECT article_id, w AS word, CAST(rk AS INTEGER) AS rank FROM ({_RANKED_WORDS}) WHERE rk <= 3""",
    a=ARTICLES))
def w06(spark, sf):
    """The relational form: count, then rank within the document."""
    from newsgrid.operators.grouped import top_per_group
    text = enrich.article_text(F.col("title"), F.col("content"))
    words = articles(spark, sf).select("article_id", F.posexplode(tx.lower_tokens(text))
                                       .alias("pos", "word"))
    n = words.groupBy("article_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return top_per_group(n, ["article_id"], [F.desc("n"), F.asc("pos")], 3).select(
        "article_id", "word", "rank")


@query("c01_enrich_articles", with_views(f"""
SELECT a.article_id, CASE WHEN s.c >= 0.15 THEN 'positive' WHEN s.c <= -0.15 THEN 'negative'
         ELSE 'neutral' END AS sentiment, s.c AS sentiment_score,
       greatest(-100, least(100, a.bias_baseline + greatest(-25, least(25, 3 * (
         {d_substrs('lower(' + _TEXT + ')', AW.right)}
         - {d_substrs('lower(' + _TEXT + ')', AW.left)}))))) AS bias_score,
       coalesce(t.topics, '') AS topics, coalesce(k.keywords, '') AS keywords,
       coalesce(e.persons, '') AS persons
FROM a
LEFT JOIN (SELECT article_id, string_agg(topic, ',' ORDER BY rk) AS topics
           FROM ({_topic_counts_sql()}) WHERE rk <= 4 GROUP BY article_id) t
  ON a.article_id = t.article_id
LEFT JOIN ({_KEYWORDS}) k ON a.article_id = k.article_id
LEFT JOIN ({_ENTS}) e ON a.article_id = e.article_id
LEFT JOIN (SELECT article_id, round_even(coalesce(sum(v.val), 0.0)
             / sqrt(coalesce(sum(v.val), 0.0) * coalesce(sum(v.val), 0.0) + 15), 3) AS c
           FROM (SELECT article_id, unnest({d_tokens('lower(' + _TEXT + ')')}) AS w FROM a) x
           LEFT JOIN ({_valence_rows()}) AS v(word, val) ON x.w = v.word GROUP BY article_id) s
  ON a.article_id = s.article_id""", a=ARTICLES), longs=True)
def c01(spark, sf):
    out = enrich.enrich_articles(articles(spark, sf).drop("sentiment"), AW, excerpt=None)
    return out.select("article_id", "sentiment", "sentiment_score", "bias_score",
                      F.array_join("topics", ",").alias("topics"),
                      F.array_join("keywords", ",").alias("keywords"),
                      F.array_join("entities.persons", "|").alias("persons"))


@query("p02_nlp_payload", with_views(f"""
SELECT a.article_id, coalesce(array_to_string(string_split(e.persons, '|')[1:3], '|'), '') AS persons,
       round_even(bias_baseline / 7.0, 3) AS score
FROM a LEFT JOIN ({_ENTS}) e ON a.article_id = e.article_id""", a=ARTICLES))
def p02(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select(
        "article_id", F.array_join(arrays.head(enrich.entities(text, AW.stop)["persons"], 3), "|")
        .alias("persons"), numbers.round_half_even(F.col("bias_baseline") / 7.0, 3).alias("score"))


# -- lexicon joins ------------------------------------------------------------------

_TERM_ROWS = [(cat, i, w) for i, (cat, terms) in enumerate(IW.topics.items())
              for w in terms]


def lexicon_table(spark):
    return small_table(spark, _TERM_ROWS, "category, ord, term")


_HITS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT doc_id, '{c}' AS category, {i} AS ord, "
    f"{d_terms('lower(text)', d_tokens('lower(text)'), terms)} AS hits FROM documents) WHERE hits > 0"
    for i, (c, terms) in enumerate(IW.topics.items()))


@query("j07_text_lexicon_match", f"SELECT doc_id, category, hits FROM ({_HITS})", longs=True)
def j07(spark, sf):
    return lx.category_hits_join(docs(spark, sf), "doc_id", "text", lexicon_table(spark))


@query("a20_lexicon_hit_totals", "SELECT doc_id, " + ", ".join(
    f"{d_terms('lower(text)', d_tokens('lower(text)'), t)} AS n_{c}" for c, t in IW.topics.items())
    + " FROM documents", longs=True)
def a20(spark, sf):
    d = docs(spark, sf).select("doc_id", F.lower("text").alias("text"))
    return lx.count_by_category(d, "text", IW.topics).drop("text")


@query("a21_best_category", f"""
SELECT doc_id, category, hits FROM ({_HITS})
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) = 1""", longs=True)
def a21(spark, sf):
    lex = lexicon_table(spark)
    hits = lx.category_hits_join(docs(spark, sf), "doc_id", "text", lex).join(
        lex.select("category", "ord").distinct(), "category")
    return lx.best_category(hits, "doc_id", "hits", "ord")


@query("a22_ordered_distinct", f"""
SELECT doc_id, len(list_distinct(l)) AS n_exact, len(list_distinct(list_transform(l, lambda x: lower(x))))
  AS n_folded FROM (SELECT doc_id, regexp_extract_all({d_ascii('text')}, '{_SPANS}') AS l
                    FROM documents)""")
def a22(spark, sf):
    s = tx.capitalised_spans(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", F.size(F.array_distinct(s)).cast("long").alias("n_exact"),
        F.size(arrays.distinct_ignoring_case(s)).cast("long").alias("n_folded"))


# -- classifier ----------------------------------------------------------------------

def _hard(title: str) -> str:
    pats = " OR ".join(f"regexp_matches({title}, '{p}')" for p in IW.excluded_patterns)
    return f"({d_any(title, IW.excluded)} OR {pats})"


def _strip(text: str) -> str:
    for p in IW.metaphors:
        text = f"replace({text}, '{p}', ' ')"
    return text


def _class_sql(src: str = "a", title: str = "title", body: str = "content") -> str:
    cats = []
    for i, (c, terms) in enumerate(IW.topics.items()):
        tv = d_terms("tc", "tt", terms), d_terms("bc", "bt", terms)
        vv = d_terms("tc", "tt", IW.verbs[c]), d_terms("bc", "bt", IW.verbs[c])
        cats.append(f"({i}, '{c}', 2 * {tv[0]} + {tv[1]}, 2 * {vv[0]} + {vv[1]})")
    return f"""
    SELECT article_id, type, CASE WHEN high >= 2 THEN 'high' WHEN high >= 1 OR med >= 2 THEN 'medium'
             ELSE 'low' END AS severity, CAST(round_even(score, 2) AS DOUBLE) AS confidence
    FROM (SELECT x.article_id, x.high, x.med, c.type, least(1.0, c.topic * 0.20 + c.verb * 0.40)
                   AS score, c.ord
          FROM (SELECT article_id, tc, bc, {d_tokens('tc')} AS tt, {d_tokens('bc')} AS bt,
                       {d_distinct('full_text', IW.severe)} AS high,
                       {d_distinct('full_text', IW.moderate)} AS med
                FROM (SELECT article_id, t, {_strip('t')} AS tc, {_strip('b')} AS bc,
                             t || ' ' || b AS full_text
                      FROM (SELECT article_id, lower({title}) AS t, lower({body}) AS b FROM {src}))
                WHERE NOT {_hard('t')} AND {d_distinct('full_text', IW.excluded)} < 2) x,
               LATERAL (SELECT * FROM (VALUES {', '.join(cats)}) AS c(ord, type, topic, verb)) c
          WHERE c.topic > 0 AND (c.verb > 0 OR c.topic >= 3))
    WHERE score >= 0.30
    QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) = 1"""


@query("c07_classify_incidents", with_views(_class_sql(), a=ARTICLES))
def c07(spark, sf):
    out = cl.classify_incidents(articles(spark, sf).select("article_id", "title", "content"), IW)
    return out.filter(F.col("incident").isNotNull()).select("article_id", "incident.*")


_VOCABULARY = [(kind, cat, i, w) for kind, table in (("topic", IW.topics), ("verb", IW.verbs))
               for i, (cat, terms) in enumerate(table.items()) for w in terms]


def vocabulary(spark):
    return small_table(spark, _VOCABULARY, "kind, category, ord, term")


@query("c07_classify_by_vocabulary_table", with_views(_class_sql(), a=ARTICLES))
def c07_table(spark, sf):
    rows = articles(spark, sf).select("article_id", "title", "content")
    out = cl.classify_incidents_join(rows, "article_id", vocabulary(spark), IW)
    return out.filter(F.col("incident").isNotNull()).select("article_id", "incident.*")


def _gate_sql(title: str = "t", body: str = "b", tt: str = "tt", bt: str = "bt") -> str:
    topics = [w for t in IW.topics.values() for w in t]
    verbs = [w for t in IW.verbs.values() for w in t]
    anyw = " OR ".join(f"{d_terms(x, k, terms)} > 0" for x, k in ((title, tt), (body, bt))
                       for terms in (topics, verbs))
    return f"""CASE WHEN {_hard(title)} THEN {d_any(title, IW.rescue)}
        WHEN {d_any(title, IW.headline)} THEN true
        WHEN {d_any(title, IW.cues)} AND ({d_any(body, IW.headline)}
             OR {d_terms(body, bt, topics)} > 0) THEN true
        ELSE ({anyw}) END"""


_GATE_SRC = f"""(SELECT *, {d_tokens('t')} AS tt, {d_tokens('b')} AS bt FROM (
    SELECT *, lower(title) AS t, lower(content) AS b FROM a))"""


@query("c08_gate_incidents", with_views(f"""
SELECT article_id FROM {_GATE_SRC} WHERE {_gate_sql()}""", a=ARTICLES))
def c08(spark, sf):
    return cl.gate_incidents(articles(spark, sf), IW).select("article_id")


@query("c08_gate_by_vocabulary_table", with_views(f"""
SELECT article_id FROM {_GATE_SRC} WHERE {_gate_sql()}""", a=ARTICLES))
def c08_table(spark, sf):
    return cl.gate_incidents_join(articles(spark, sf), "article_id", vocabulary(spark), IW).select("article_id")


@query("p20_hard_exclusion", with_views(f"""
SELECT article_id FROM a WHERE {_hard('lower(title)')}""", a=ARTICLES))
def p20(spark, sf):
    return articles(spark, sf).filter(cl.hard_excluded(F.lower("title"), IW)).select("article_id")


@query("p21_soft_exclusion", with_views(f"""
SELECT article_id FROM a WHERE {d_distinct("lower(title || ' ' || content)", IW.excluded)} >= 2""",
    a=ARTICLES))
def p21(spark, sf):
    full = F.lower(F.concat("title", F.lit(" "), "content"))
    return articles(spark, sf).filter(tx.distinct_contained(full, IW.excluded) >= 2).select(
        "article_id")


@query("p22_gate_marks", with_views(f"""
SELECT lang, {_gate_sql()} AS candidate, count(*) AS n FROM {_GATE_SRC} GROUP BY 1, 2""",
    a=ARTICLES))
def p22(spark, sf):
    out = cl.gate_incidents(articles(spark, sf), IW, column="candidate")
    return out.groupBy("lang", "candidate").agg(F.count("*").alias("n"))


@query("p19_confidence_thresholds", with_views(f"""
SELECT CASE WHEN confidence < 0.60 THEN 'review' ELSE 'publish' END AS route, count(*) AS n
FROM ({_class_sql()}) GROUP BY 1""", a=ARTICLES))
def p19(spark, sf):
    out = cl.classify_incidents(articles(spark, sf).select("article_id", "title", "content"), IW)
    conf = F.col("incident.confidence")
    return (out.filter(conf >= cl.CONFIDENCE_MIN)
            .groupBy(F.when(conf < cl.CONFIDENCE_REVIEW, "review").otherwise("publish")
                     .alias("route")).agg(F.count("*").alias("n")))


# -- scorer answers --------------------------------------------------------------------

# A scorer's reply for every order: fenced, wrapped in prose, plain or broken.
_REPLY = """
SELECT o_orderkey AS incident_id, concat(
  CASE o_orderkey % 4 WHEN 0 THEN '```json ' WHEN 1 THEN 'Here it is: ' ELSE '' END,
  '{', CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE '"is_incident": ' END,
  CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'P' THEN '"false"' ELSE '"yes"' END,
  ', "incident_type": "', CASE o_orderpriority WHEN '1-URGENT' THEN ' Fire' WHEN '2-HIGH' THEN 'flood'
    ELSE o_orderpriority END,
  '", "severity": "', CASE o_orderstatus WHEN 'F' THEN 'HIGH' ELSE 'odd' END,
  '", "confidence": ', CAST(o_custkey AS VARCHAR(20)), 'e-3, "flags": ["Rumor ", "", "x"]',
  ', "summary": ""}', CASE o_orderkey % 4 WHEN 0 THEN ' ```' WHEN 1 THEN ' hope it helps' ELSE '' END
  ) AS reply FROM {orders}
""".replace("'{', CASE", "chr(123), CASE").replace("\"summary\": \"\"}'", "\"summary\": \"\"', chr(125)")


_BROKEN = "(incident_id % 4 = 3)"


@query("x03_loose_json", with_views(f"""
SELECT incident_id, NOT {_BROKEN} AS valid FROM r""", r=_REPLY))
def x03(spark, sf):
    return view(spark, sf, _REPLY).select(
        "incident_id", loose_object(F.col("reply")).isNotNull().alias("valid"))


@query("x05_coerce_assessment", """
SELECT o_orderkey AS incident_id, o_orderstatus <> 'P' AS is_incident,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'fire' WHEN '2-HIGH' THEN 'flood' ELSE 'info' END
         AS incident_type,
       CASE o_orderstatus WHEN 'F' THEN 'high' ELSE 'low' END AS severity,
       round_even(least(1.0, o_custkey / 1000.0), 2) AS confidence,
       'rumor,x' AS flags, 'Incident ' || o_orderkey AS summary
FROM orders WHERE o_orderkey % 4 <> 3""")
def x05(spark, sf):
    r = view(spark, sf, _REPLY)
    c = coerce_assessment(loose_object(F.col("reply")), F.concat(
        F.lit("Incident "), F.col("incident_id").cast("string")), "m")
    out = arrays.evaluate_once(r, c=c).filter(F.col("c").isNotNull())
    return out.select("incident_id", "c.is_incident", "c.incident_type", "c.severity",
                      "c.confidence", F.array_join("c.flags", ",").alias("flags"), "c.summary")


_SCORED = f"""
SELECT a.article_id, CASE WHEN doc_ok THEN 'scorer' ELSE 'keyword-fallback' END AS model,
       CASE WHEN doc_ok THEN true ELSE c.type IS NOT NULL END AS is_incident,
       CASE WHEN doc_ok THEN 'police' ELSE coalesce(c.type, 'info') END AS incident_type,
       CASE WHEN doc_ok THEN 'high' ELSE coalesce(c.severity, 'low') END AS severity,
       CASE WHEN doc_ok THEN CAST(0.75 AS DOUBLE) ELSE coalesce(c.confidence, CAST(0 AS DOUBLE)) END
         AS confidence,
       CASE WHEN doc_ok THEN 'single_source' ELSE 'llm_unavailable' END AS flags
FROM (SELECT *, contains(title, 'th') AS doc_ok FROM a) a
LEFT JOIN ({_class_sql()}) c ON a.article_id = c.article_id"""


def demo_scorer(title, body):
    """Answers for titles with ``th``; garbage otherwise."""
    return F.when(F.contains(title, F.lit("th")), F.lit(
        '```json\n{"is_incident": true, "incident_type": "police", "severity": "high", '
        '"confidence": 0.75, "flags": "single_source"}\n```')).otherwise(F.lit("no idea"))


def _flat_intel(df):
    return df.select("article_id", "intel.model", "intel.is_incident", "intel.incident_type",
                     "intel.severity", "intel.confidence",
                     F.array_join("intel.flags", ",").alias("flags"))


@query("c24_score_incidents", with_views(_SCORED, a=ARTICLES))
def c24(spark, sf):
    return _flat_intel(cl.score_incidents(articles(spark, sf), IW, demo_scorer))


@query("v01_scorer_as_pandas_udf", with_views(_SCORED, a=ARTICLES))
def v01(spark, sf):
    """The same scorer as an Arrow-batched Python function."""
    @F.pandas_udf("string")
    def answer(title: pd.Series, body: pd.Series) -> pd.Series:
        hit = ('{"is_incident": true, "incident_type": "police", "severity": "high", '
               '"confidence": 0.75, "flags": ["single_source"]}')
        return title.fillna("").str.contains("th", regex=False).map({True: hit, False: "no idea"})

    return _flat_intel(cl.score_incidents(articles(spark, sf), IW, lambda t, b: answer(t, b)))


@query("p03_ai_payload", with_views(f"""
SELECT article_id, title AS ai_summary, flags AS ai_flags, model AS ai_model
FROM (SELECT s.*, CASE WHEN s.model = 'scorer' THEN a.title ELSE a.title END AS title
      FROM ({_SCORED}) s JOIN a ON a.article_id = s.article_id)""", a=ARTICLES))
def p03(spark, sf):
    scored = cl.score_incidents(articles(spark, sf), IW, demo_scorer)
    p = cl.ai_payload(F.col("intel"), F.lit(AS_OF).cast("timestamp"))
    return scored.select("article_id", p.alias("p")).select(
        "article_id", "p.ai_summary", "p.ai_flags", "p.ai_model")


@query("a17_backfill_outcomes", with_views(f"""
SELECT CASE model WHEN 'scorer' THEN 'updated' ELSE 'fallback' END AS outcome, count(*) AS n
FROM ({_SCORED}) GROUP BY 1""", a=ARTICLES))
def a17(spark, sf):
    scored = cl.score_incidents(articles(spark, sf), IW, demo_scorer)
    return moderation.backfill_outcomes(scored).groupBy("outcome").agg(F.count("*").alias("n"))


@query("p18_review_reasons", with_views("""
SELECT incident_id, concat_ws('; ',
  CASE WHEN c < 0.60 THEN 'low classification confidence (' || printf('%.2f', c) || ')' END,
  CASE WHEN location_precision = 'county' OR sp <= 1 THEN 'imprecise location (' || type || ')' END,
  CASE WHEN coalesce(ai_model, '') = 'keyword' THEN 'LLM unavailable — keyword fallback used' END,
  CASE WHEN severity = 'high' THEN 'editorial flag: rumor, x' END) AS reason
FROM (SELECT *, (cust_id % 100) / 100.0 AS c, CAST(amount / 100000 AS INTEGER) AS sp FROM i)""",
    i=INCIDENTS))
def p18(spark, sf):
    i = incidents(spark, sf).withColumn("c", (F.col("cust_id") % 100) / F.lit(100.0)).withColumn(
        "sp", F.round(F.col("amount") / 100000).cast("int"))
    flags = F.when(F.col("severity") == "high", F.array(F.lit("rumor"), F.lit("x"))).otherwise(
        F.array(F.lit("y")))
    reason = moderation.review_reason(
        F.col("c"), F.coalesce(F.col("location_precision") == "county", F.lit(False)),
        F.col("sp"), F.col("type"), tx.blank_if_null(F.col("ai_model")) == "keyword", flags)
    return i.select("incident_id", reason.alias("reason"))


@query("p30_confidence_band", with_views("""
SELECT incident_id, CASE WHEN c >= 0.4 THEN 'good' WHEN c >= 0.3 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT incident_id, (cust_id % 100) / 100.0 AS c FROM i)""", i=INCIDENTS))
def p30(spark, sf):
    return incidents(spark, sf).select("incident_id", moderation.confidence_band(
        (F.col("cust_id") % 100) / F.lit(100.0)).alias("band"))


# -- arrays, JSON, numbers --------------------------------------------------------------

@query("x01_explode_topics", with_views(f"""
SELECT article_id, topic, CAST(rk - 1 AS INTEGER) AS pos FROM ({_topic_counts_sql()}) WHERE rk <= 4""",
    a=ARTICLES))
def x01(spark, sf):
    text = enrich.article_text(F.col("title"), F.col("content"))
    return articles(spark, sf).select("article_id", F.posexplode(enrich.topics(text, AW.topics))
                                      .alias("pos", "topic"))


@query("x02_entities_from_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' ||
  json_extract_string(props, '$.k') END AS persons FROM events""")
def x02(spark, sf):
    e = table(spark, sf, "events")
    ok = F.to_json(F.struct(F.array("event_type", F.get_json_object("props", "$.k"))
                            .alias("persons")))
    stored = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken"), "props")).otherwise(
        ok)
    return e.select("event_id", F.array_join(parse_entities(stored)["persons"], "|")
                    .alias("persons"))


@query("x06_flags_text_and_list", """
SELECT doc_id, len(l) AS n, array_to_string(l, ',') AS joined FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, ','),
                 lambda x: trim(x)), lambda x: trim(x) <> '') AS l FROM documents)""", longs=True)
def x06(spark, sf):
    parts = arrays.split_list(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(parts).alias("n"), arrays.join_list(parts)
                                  .alias("joined"))


@query("x07_flag_overlap", """
SELECT doc_id FROM documents WHERE len(list_intersect(
  string_split(lower(text), ' '), ['tion', 'than', 'nicht', 'elle'])) > 0""")
def x07(spark, sf):
    words = F.split(F.lower("text"), " ")
    return docs(spark, sf).filter(F.arrays_overlap(words, arrays.strings(
        ["tion", "than", "nicht", "elle"]))).select("doc_id")


@query("x08_list_truncation", """
SELECT doc_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS first8
FROM documents""")
def x08(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(arrays.head(F.split(
        F.col("text"), " "), 8), " ").alias("first8"))


_PARTS_TEXT = r"""md5(array_to_string(list_transform(list_filter(list_transform(
         range(1, len(l) + 1), lambda i: struct_pack(i := i, b := trim(regexp_replace(l[i], '\s+', ' ', 'g')))),
         lambda p: p.b <> ''), lambda p: '## Part ' || (p.i - 1) || chr(10) || p.b), chr(10) || chr(10)))"""


def text_parts():
    """A turn's lines as titled parts of one nested document."""
    return F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        F.concat(F.lit("Part "), i.cast("string")).alias("title"), line.alias("body")))


@query("x09_nested_parts_to_text", f"""
SELECT conv_id, turn, {_PARTS_TEXT} AS h
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)""")
def x09(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(
        joined_parts(text_parts())).alias("h"))


@query("m02_weighted_score", """
SELECT l_orderkey, l_linenumber, least(1.0, (l_linenumber - 1) * 0.20 + floor(l_quantity / 20) * 0.40)
  AS score FROM lineitem""")
def m02(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.weighted_score(
        F.col("l_linenumber") - 1, F.floor(F.col("l_quantity") / 20)).alias("score"))


@query("m03_clamps", """
SELECT c_custkey, greatest(-100.0, least(100.0, c_acctbal / 10)) AS bias,
       greatest(1, least(200, c_custkey)) AS page_size FROM customer""")
def m03(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", numbers.clamp(F.col("c_acctbal") / 10, -100.0, 100.0).alias("bias"),
        numbers.clamp(F.col("c_custkey"), 1, 200).alias("page_size"))


@query("m04_rounding", """
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 1) AS even, round(l_quantity / 8, 1)
  AS up FROM lineitem""")
def m04(spark, sf):
    q = F.col("l_quantity") / 8
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_even(q, 1)
                                               .alias("even"), F.round(q, 1).alias("up"))


@query("m06_safe_percentage", """
SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN round(c_custkey * 100.0 / c_nationkey) ELSE 0 END
  AS pct FROM customer""")
def m06(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.percent(
        F.col("c_custkey"), F.col("c_nationkey")).alias("pct"))


@query("v02_sentiment_backend", with_views("""
SELECT article_id, round_even(len(string_split(content, 'tion')) / 1000.0, 3) AS score,
       CASE WHEN round_even(len(string_split(content, 'tion')) / 1000.0, 3) >= 0.15 THEN 'positive'
            ELSE 'neutral' END AS label FROM a""", a=ARTICLES))
def v02(spark, sf):
    """A caller's own score in place of the valence table."""
    def score(text):
        return F.size(F.split(F.col("content"), "tion")) / F.lit(1000.0)
    out = enrich.enrich_articles(articles(spark, sf).drop("sentiment"), AW, excerpt=None,
                                 sentiment=score)
    return out.select("article_id", F.col("sentiment_score").alias("score"),
                      F.col("sentiment").alias("label"))
