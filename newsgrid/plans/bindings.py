"""How the operators are bound to the standard tables.

Each view is one SQL text that Spark and DuckDB both read, so the catalogue's
queries and their oracles start from the same rows.  The text tables hold
invented words, so the vocabularies below are words that do occur in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.operators.lexicon import ArticleLexicon, IncidentLexicon

AS_OF = "2024-01-31 00:00:00"
INCIDENT_AS_OF = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table; stored times are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view whose ``{table}`` names are standard tables."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def plain(text: str) -> str:
    """The same view for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_views(sql: str, **views: str) -> str:
    parts = [f"{name} AS ({plain(text)})" for name, text in views.items()]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(parts) + " " + body


# Articles: exact-copy texts share a URL, so de-duplication has work to do.
ARTICLES = """
SELECT doc_id AS article_id, concat('https://news.example/', md5(text)) AS url,
       split_part(text, chr(10), 1) AS title, text AS content, source, lang,
       CAST(doc_id % 5 + 1 AS INTEGER) AS tier,
       CAST(doc_id % 41 - 20 AS INTEGER) AS bias_baseline,
       CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
       TIMESTAMP '2024-01-31 00:00:00'
         - (doc_id * 7919 % 2592000) * INTERVAL '1' SECOND AS published_at
FROM {documents}
"""

# URLs an earlier run has taken: those of labelled documents.
SEEN = """
SELECT DISTINCT concat('https://news.example/', md5(d.text)) AS url
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Stored articles: the documents with a French or Spanish text, some of them trashed.
STORE = """
SELECT doc_id + 1000000 AS stored_id, concat('https://news.example/', md5(text)) AS url,
       CASE lang WHEN 'fr' THEN 'publish' ELSE 'trash' END AS post_status
FROM {documents} WHERE lang IN ('fr', 'es')
"""

INCIDENTS = """
SELECT o_orderkey AS incident_id, concat('Incident ', CAST(o_orderkey AS VARCHAR(20))) AS title,
       concat('https://news.example/', CAST(o_custkey AS VARCHAR(20))) AS source_url,
       o_orderpriority AS type,
       CASE o_orderstatus WHEN 'O' THEN 'low' WHEN 'F' THEN 'high' ELSE 'medium' END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'developing'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'resolved' END END AS lifecycle,
       CASE WHEN o_orderkey % 10 = 0 THEN 'pending' ELSE 'publish' END AS post_status,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS last_update_at,
       CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate END AS incident_time,
       o_orderdate AS modified_at, o_orderdate AS created_at,
       o_orderdate + INTERVAL '7' DAY AS expires_at,
       o_orderkey % 6 = 0 AS expiry_warned,
       CAST(o_orderkey * 7919 % 1300 AS DOUBLE) / 100 - CAST(6.5 AS DOUBLE) AS latitude,
       CAST(o_orderkey * 104729 % 1100 AS DOUBLE) / 100 + CAST(32.5 AS DOUBLE) AS longitude,
       CASE WHEN o_orderkey % 3 = 0 THEN 'keyword' WHEN o_orderkey % 3 = 1 THEN '' END AS ai_model,
       o_orderkey % 7 = 0 AS needs_review,
       CASE WHEN o_orderkey % 9 = 0 THEN false WHEN o_orderkey % 9 = 1 THEN true END AS is_verified,
       CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'subcounty' WHEN 2 THEN 'county'
            WHEN 3 THEN 'country' END AS location_precision,
       CAST(o_orderkey % 4 AS INTEGER) AS update_count,
       CAST(o_custkey % 3 AS INTEGER) AS corroboration_count,
       CAST(o_totalprice AS DOUBLE) AS amount, o_custkey AS cust_id
FROM {orders}
"""

# Follow-ups; (order, line) pairs may repeat, so copies are folded into one.
UPDATES = """
SELECT l_orderkey * 10 + l_linenumber AS update_id, l_orderkey AS incident_id,
       min(CASE l_returnflag WHEN 'A' THEN 'publish' WHEN 'N' THEN 'pending' ELSE 'trash' END)
         AS status,
       max(l_shipdate) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

REQUESTS = """
SELECT event_id, user_id AS client, ts, event_type, value,
       value * CAST(0.6 AS DOUBLE) - 8 AS latitude, value * CAST(0.9 AS DOUBLE) + 30 AS longitude
FROM {events}
"""

RUNS = """
SELECT event_type AS label, ts AS run_at, event_id,
       CASE WHEN value < 30 THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS articles_seen
FROM {events}
"""

# Attribute rows: every order's columns as (key, value) pairs.
META = """
SELECT o_orderkey * 4 AS meta_id, o_orderkey AS post_id, 'source' AS meta_key,
       o_orderpriority AS meta_value FROM {orders}
UNION ALL SELECT o_orderkey * 4 + 1, o_orderkey, 'status', o_orderstatus FROM {orders}
UNION ALL SELECT o_orderkey * 4 + 2, o_orderkey, 'author', CAST(o_custkey AS VARCHAR(20))
  FROM {orders} WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey * 4 + 3, o_orderkey, 'source', 'second value' FROM {orders}
"""

POSTS = """
SELECT o_orderkey AS post_id, 'article' AS record_type,
       CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'publish' END AS post_status,
       o_orderdate AS date_gmt FROM {orders}
"""

COUNTIES_ROWS = [
    # ord, name, slug, lat, lng, pad, subs
    (0, "North Reach", "north-reach", 2.5, 35.5, 1.5, []),
    (1, "East Hollow", "east-hollow", 1.0, 39.5, 1.5, [("Upper Hollow", 1.5, 39.0),
                                                      ("Lower Hollow", 0.5, 40.0)]),
    (2, "Mid Vale", "mid-vale", -0.5, 36.5, 1.0, []),
    (3, "South Bank", "south-bank", -3.0, 38.0, 1.25, [("Old Bank", -3.25, 38.25)]),
    (4, "Lake Side", "lake-side", -0.5, 34.5, 0.75, []),
    (5, "Far Coast", "far-coast", -3.5, 39.75, 0.75, []),
]
COUNTRIES_ROWS = [
    # ord, name, slug, lat, lng, box
    (0, "Kenya", "kenya", 0.0236, 37.9062, (-4.72, 33.91, 5.02, 41.91)),
    (1, "West Land", "west-land", 1.25, 32.5, (-1.5, 29.5, 4.25, 35.0)),
    (2, "Open Land", "open-land", 10.0, 20.0, None),
]


def small_table(spark: SparkSession, rows, names: str) -> DataFrame:
    """Inline rows with a known size, so that joins can tell they are small."""
    return spark.sql(f"SELECT * FROM ({values_sql(rows)}) AS t({names})")


def counties(spark: SparkSession) -> DataFrame:
    from newsgrid.schemas import COUNTY
    flat = small_table(spark, [(o, n, s, la, ln, la - p, ln - p, la + p, ln + p)
                               for o, n, s, la, ln, p, _ in COUNTIES_ROWS],
                       "ord, name, slug, lat, lng, min_lat, min_lng, max_lat, max_lng")
    subs = F.array().cast(COUNTY.split("subs ")[1])
    for slug, subs_of in [(r[2], r[6]) for r in COUNTIES_ROWS if r[6]]:
        listed = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(a.lower().replace(" ", "-"))
                                    .alias("slug"), F.lit(y).alias("lat"), F.lit(x).alias("lng"))
                           for a, y, x in subs_of])
        subs = F.when(F.col("slug") == slug, listed).otherwise(subs)
    return flat.withColumn("subs", subs)


def county_dicts() -> list[dict]:
    return [{"ord": o, "name": n, "slug": s, "lat": la, "lng": ln}
            for o, n, s, la, ln, _, _ in COUNTIES_ROWS]


def countries(spark: SparkSession) -> DataFrame:
    rows = [(o, n, s, la, ln, *(b or (None,) * 4)) for o, n, s, la, ln, b in COUNTRIES_ROWS]
    return small_table(spark, rows,
                       "ord, name, slug, lat, lng, min_lat, min_lng, max_lat, max_lng")


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def values_sql(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def counties_sql() -> str:
    rows = [(o, n, s, la, ln, la - p, ln - p, la + p, ln + p, len(subs))
            for o, n, s, la, ln, p, subs in COUNTIES_ROWS]
    return ("SELECT * FROM (" + values_sql(rows) + ") AS t(ord, name, slug, lat, lng, min_lat, "
            "min_lng, max_lat, max_lng, n_subs)")


def subs_sql() -> str:
    rows = [(s, a, a.lower().replace(" ", "-"), y, x)
            for _, _, s, _, _, _, subs in COUNTIES_ROWS for a, y, x in subs]
    return "SELECT * FROM (" + values_sql(rows) + ") AS t(county, name, slug, lat, lng)"


def countries_sql() -> str:
    rows = [(o, n, s, la, ln, *(b or (None,) * 4)) for o, n, s, la, ln, b in COUNTRIES_ROWS]
    return ("SELECT * FROM (" + values_sql(rows) + ") AS t(ord, name, slug, lat, lng, min_lat, "
            "min_lng, max_lat, max_lng)")


INCIDENT_WORDS = IncidentLexicon(
    topics={
        "fire": ["heat", "oned", "rent", "thin and"],
        "flood": ["thor", "anea", "reti"],
        "accident": ["keit", "nicht", "ered"],
        "police": ["elle", "pour"],
        "protest": ["para", "tion", "of the"],
        "weather": ["here", "onst", "ning"],
        "health": ["rest", "than"],
        "military": ["erin", "thes"],
        "medical": ["eror", "then"],
    },
    verbs={
        "fire": ["hein", "with the"],
        "flood": ["thou", "rely"],
        "accident": ["sich", "lich"],
        "police": ["ment", "oure"],
        "protest": ["thing", "from"],
        "weather": ["only", "enon"],
        "health": ["thre"],
        "military": ["eran", "anon"],
        "medical": ["thly", "ther"],
    },
    excluded=["reedes", "laleen", "asci", "license", "apache"],
    excluded_patterns=[r"\bthanea\b.*\bthanedble\b"],
    metaphors=["thin and", "here the", "ered on"],
    severe=["onst", "thwh", "edst"],
    moderate=["erly", "ansh", "heha"],
    rescue=["erin", "tion"],
    headline=["attion", "ndble", "erreth", "innd"],
    cues=["that", "esndha"],
)

ARTICLE_WORDS = ArticleLexicon(
    valence={"heat": -1.5, "rest": 1.0, "only": -0.5, "here": 0.5, "thing": 1.0, "than": -1.5,
             "then": 2.0, "nicht": -1.0, "pour": 0.5, "para": 1.0, "elle": 1.0, "rent": -2.0},
    left=["onst", "thin", "eux"],
    right=["than", "hehe", "keit"],
    topics={"economy": ["onst", "rent"], "health": ["heat", "thin"], "security": ["hehe", "nicht"],
            "sport": ["than ", "oured"], "culture": ["elle", "para "], "politics": ["tion of"],
            "science": ["ment "]},
    stop=["tion", "from", "with", "that", "this", "anon"],
)

GAZETTEER = [
    {"ord": i, "name": n, "lat": la, "lng": ln, "specificity": s}
    for i, (n, la, ln, s) in enumerate([
        ("Eriner", -1.25, 36.75, 3), ("Thin", -1.5, 36.5, 3), ("That", 0.5, 34.75, 2),
        ("Anon", -0.25, 36.0, 2), ("of the", 1.0, 35.25, 2), ("the of", 1.25, 35.5, 1),
        ("Nicht", 2.0, 37.0, 1), ("Elle", 3.0, 38.0, 1), ("Para", -2.0, 39.0, 1)])
]
TITLE_STOPS = ["That", "This", "With", "From"]
PLACES = [("tion", 5.5, 10.25), ("thon", 6.5, 11.25), ("eren", 7.5, 12.25), ("retion", 8.5, 13.25),
          ("erst", 9.5, 14.25), ("ther", 1.5, 2.25), ("thly", 3.5, 4.25)]


def places(spark: SparkSession) -> DataFrame:
    return small_table(spark, PLACES, "name, lat, lng")


# -- oracle snippets ------------------------------------------------------------

def d_tokens(text: str) -> str:
    return rf"regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_]+')"


def d_words(tokens: str, words) -> str:
    words = [w for w in words if " " not in w and "-" not in w]
    if not words:
        return "0"
    return f"len(list_filter({tokens}, lambda w: w IN ({quoted(words)})))"


def d_substr(text: str, term: str) -> str:
    q = "'" + term.replace("'", "''") + "'"
    return f"((length({text}) - length(replace({text}, {q}, ''))) // {len(term)})"


def d_substrs(text: str, terms) -> str:
    return "(" + (" + ".join(d_substr(text, t) for t in terms) or "0") + ")"


def d_terms(text: str, tokens: str, terms) -> str:
    phrases = [t for t in terms if " " in t or "-" in t]
    return f"({d_words(tokens, terms)} + {d_substrs(text, phrases)})"


def d_any(text: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({text}, {quoted([t])})" for t in terms) or "false") + ")"


def d_distinct(text: str, terms) -> str:
    return "(" + (" + ".join(f"CAST(contains({text}, {quoted([t])}) AS INTEGER)" for t in terms)
                  or "0") + ")"


def d_ascii(text: str) -> str:
    """Letters outside ASCII as underscores: word characters for an ASCII ``\\b``."""
    return rf"regexp_replace({text}, '[^\x00-\x7F]', '_', 'g')"
