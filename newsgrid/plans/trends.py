"""Windowed trend roll-ups in one pass over the articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.functions.dates import in_window, local_date

# How many names each ranked facet shows.
SHOWN = {"source": 15, "topic": 10, "person": 10, "org": 10, "place": 10}
SENTIMENTS = ("positive", "neutral", "negative")
TIERS = (1, 2, 3, 4, 5)


def _facet(name: str, key: Column, use: Column | None = None) -> Column:
    entry = F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key"),
                     F.lit(0).alias("pos"))
    return F.array(entry) if use is None else F.when(use, F.array(entry)).otherwise(
        F.filter(F.array(entry), lambda _: F.lit(False)))


def _facets(name: str, keys: Column) -> Column:
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k, i: F.struct(
        F.lit(name).alias("facet"), k.alias("key"), i.alias("pos")))


def recent(articles: DataFrame, as_of, window: str, ts: str = "published_at",
           row_id: str = "article_id", max_rows: int | None = None) -> DataFrame:
    """Articles strictly inside the window; optionally only the newest ``max_rows``."""
    rows = articles.filter(in_window(F.col(ts), as_of, window))
    return rows if max_rows is None else rows.orderBy(F.desc(ts), F.desc(row_id)).limit(max_rows)


def facet_counts(articles: DataFrame, ts: str = "published_at", row_id: str = "article_id",
                 zone: str = "UTC") -> DataFrame:
    """``facet, key, n, first_seen`` for every facet at once.

    Each article contributes a handful of (facet, key) entries that are counted
    map-side, so one shuffle carries one row per distinct key and map task.
    ``first_seen`` orders keys by their first appearance when reading newest
    first; it is packed into one decimal so that the aggregation stays hashed.
    """
    has = set(articles.columns)
    parts = [_facet("total", F.lit("all"))]
    if "source" in has:
        parts.append(_facet("source", F.col("source"),
                            F.coalesce(F.col("source"), F.lit("")) != ""))
    if "sentiment" in has:
        parts.append(_facet("sentiment", F.col("sentiment"),
                            F.coalesce(F.col("sentiment").isin(*SENTIMENTS), F.lit(False))))
    if "tier" in has:
        parts.append(_facet("tier", F.col("tier"),
                            F.coalesce(F.col("tier").isin(*TIERS), F.lit(False))))
    parts.append(_facet("day", local_date(F.col(ts), zone)))
    if "topics" in has:
        parts.append(_facets("topic", F.col("topics")))
    if "entities" in has:
        for facet, field in (("person", "persons"), ("org", "orgs"), ("place", "places")):
            parts.append(_facets(facet, F.col(f"entities.{field}")))
    wide = "decimal(38,0)"
    newest = (F.unix_micros(ts).cast(wide) * F.lit(str(10 ** 19)).cast("decimal(20,0)")
              + F.col(row_id).cast(wide)).cast(wide)
    rows = articles.select(newest.alias("_at"), F.explode(F.concat(*parts)).alias("_f"))
    within = F.lit(999) - F.least(F.lit(999), F.col("_f.pos"))
    seen_at = (F.col("_at") * F.lit(1000).cast("decimal(4,0)") + within).cast(wide)
    return (rows.groupBy(F.col("_f.facet").alias("facet"), F.col("_f.key").alias("key"))
            .agg(F.count("*").alias("n"), F.max(seen_at).alias("first_seen")))


def trend_facets(articles: DataFrame, as_of, window: str = "24h", ts: str = "published_at",
                 row_id: str = "article_id", zone: str = "UTC",
                 max_rows: int | None = None) -> DataFrame:
    """``facet, rank, key, n``: the whole snapshot in long form, ranked facets cut to size.

    Fixed facets (sentiment, tier) come without their empty values; see
    ``trend_snapshot`` for the filled form.
    """
    counts = facet_counts(recent(articles, as_of, window, ts, row_id, max_rows), ts, row_id, zone)
    # Ranked facets share one group each, every other key is a group of its own:
    # a single pass, and a limit in front of the shuffle however many names there are.
    own = F.when(F.col("facet").isin(*SHOWN), F.lit("")).otherwise(F.col("key"))
    top = Window.partitionBy("facet", own).orderBy(F.desc("n"), F.desc("first_seen"), F.asc("key"))
    ranked = (counts.withColumn("rank", F.row_number().over(top))
              .filter(F.col("rank") <= max(SHOWN.values())))
    shown = F.lit(1)
    for facet, k in SHOWN.items():
        shown = F.when(F.col("facet") == facet, k).otherwise(shown)
    rank = F.when(F.col("facet").isin(*SHOWN), F.col("rank")).otherwise(0)
    return ranked.filter(F.col("rank") <= shown).select("facet", rank.alias("rank"), "key", "n")


_NAMED = "array<struct<name:string,count:bigint>>"


def trend_snapshot(articles: DataFrame, as_of, window: str = "24h", **options) -> DataFrame:
    """One row with the snapshot assembled as nested columns."""
    rows = trend_facets(articles, as_of, window, **options)

    def listing(facet: str, order: str) -> Column:
        items = F.sort_array(F.collect_list(F.when(
            F.col("facet") == facet, F.struct(F.col(order).alias("o"), F.col("key"), F.col("n")))))
        return F.transform(items, lambda i: F.struct(
            i["key"].alias("name"), i["n"].alias("count"))).cast(_NAMED)

    def fixed(facet: str, values) -> Column:
        return F.struct(*[F.coalesce(F.sum(F.when(
            (F.col("facet") == facet) & (F.col("key") == str(v)), F.col("n"))), F.lit(0))
            .alias(f"t{v}" if isinstance(v, int) else v) for v in values])

    return rows.agg(
        F.lit(window).alias("window"),
        F.coalesce(F.sum(F.when(F.col("facet") == "total", F.col("n"))), F.lit(0)).alias("total"),
        listing("source", "rank").alias("by_source"), listing("topic", "rank").alias("by_topic"),
        fixed("sentiment", SENTIMENTS).alias("by_sentiment"), fixed("tier", TIERS).alias("by_tier"),
        listing("person", "rank").alias("persons"), listing("org", "rank").alias("orgs"),
        listing("place", "rank").alias("places"), listing("day", "key").alias("timeline"))
