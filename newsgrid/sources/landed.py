"""Scans of landed records into the common article shape."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrid.functions.arrays import split_list
from newsgrid.functions.dates import parse_instant
from newsgrid.functions.records import joined_parts
from newsgrid.functions.text import (
    blank_if_null, contains_any, headline_of, publisher_of, search_feed_label, social_label,
    strip_tags,
)
from newsgrid.schemas import RAW_ARTICLE, SOCIAL_REGISTRY, SOURCE_REGISTRY


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all sources; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_articles(spark: SparkSession, paths: Sequence[str], fmt: str = "json") -> DataFrame:
    """Landed article records with the full optional column set."""
    return spark.read.format(fmt).schema(RAW_ARTICLE).load(list(paths))


def read_registry(spark: SparkSession, path: str, social: bool = False,
                  fmt: str = "json") -> DataFrame:
    schema = SOCIAL_REGISTRY if social else SOURCE_REGISTRY
    return spark.read.format(fmt).schema("ord int, " + schema).load(path)


def with_defaults(articles: DataFrame) -> DataFrame:
    """Tier 3 and baseline 0 where a record does not say."""
    return articles.withColumns({"tier": F.coalesce("tier", F.lit(3)),
                                 "bias_baseline": F.coalesce("bias_baseline", F.lit(0))})


def payload(articles: DataFrame, title_chars: int = 200, text_chars: int = 4000) -> DataFrame:
    """Outgoing article fields with their size caps."""
    caps = {"title": title_chars, "content": text_chars, "excerpt": text_chars}
    return articles.withColumns({c: F.substring(F.col(c), 1, n) for c, n in caps.items()
                                 if c in articles.columns})


def search_feed_articles(items: DataFrame, as_of, feed: str = "News search",
                         max_chars: int | None = None) -> DataFrame:
    """``items(link, title, summary, published)`` with "Headline - Publisher" titles."""
    body = strip_tags(F.col("summary"))
    content = body if max_chars is None else F.substring(body, 1, max_chars)
    return (items.filter(F.trim(blank_if_null(F.col("link"))) != "")
            .select(F.trim("link").alias("url"), headline_of(F.col("title")).alias("title"),
                    F.substring(content, 1, 280).alias("excerpt"), content.alias("content"),
                    parse_instant(F.col("published"), as_of).alias("published_at"),
                    search_feed_label(publisher_of(F.col("title")), feed).alias("source")))


def social_articles(posts: DataFrame, title_chars: int = 120) -> DataFrame:
    """``posts(id, handle, platform, text, created_at)`` as article rows."""
    return posts.select(
        F.concat(F.lit("https://twitter.com/"), "handle", F.lit("/status/"), F.col("id")
                 .cast("string")).alias("url"),
        F.substring("text", 1, title_chars).alias("title"), F.col("text").alias("excerpt"),
        F.col("text").alias("content"), F.col("created_at").alias("published_at"),
        social_label(F.col("platform"), F.col("handle")).alias("source"),
        F.col("handle").alias("social_handle"), "platform")


def search_posts(posts: DataFrame, hazards: Sequence[str], places: Sequence[str],
                 lang: str = "en") -> DataFrame:
    """(any hazard) and (any place) and language, neither repost nor reply."""
    low = F.lower("text")
    return posts.filter((F.col("lang") == lang)
                        & ~F.coalesce(F.col("is_retweet"), F.lit(False))
                        & ~F.coalesce(F.col("is_reply"), F.lit(False))
                        & contains_any(low, [h.lower() for h in hazards])
                        & contains_any(low, [p.lower() for p in places]))


def with_authors(posts: DataFrame, users: DataFrame, missing: str = "unknown") -> DataFrame:
    """Post authors by name.  ``users(id, username)`` is reduced to one row per id."""
    names = users.groupBy(F.col("id").alias("author_id")).agg(F.min("username").alias("username"))
    return (posts.join(names, "author_id", "left")
            .withColumn("username", F.coalesce("username", F.lit(missing))))


def mentions(items: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Items naming a keyword in any of the given columns."""
    return mentions_any(items, dict.fromkeys(columns, keyword))


def mentions_any(items: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """Items where any column names its keyword, in one filter."""
    hit = F.lit(False)
    for c, keyword in keywords.items():
        hit = hit | F.contains(F.lower(blank_if_null(F.col(c))), F.lit(keyword.lower()))
    return items.filter(hit)


PARTS = "struct<updated_at:string,description:string,details:struct<parts:array<struct<title:string,body:string>>>>"


def advisory_documents(docs: DataFrame, as_of, text: str = "json",
                       max_chars: int | None = None) -> DataFrame:
    """Nested advisory JSON to excerpt, content and date."""
    parsed = docs.withColumn("_doc", F.from_json(text, PARTS))
    return parsed.select(
        *[c for c in docs.columns if c != text],
        blank_if_null(F.col("_doc.description")).alias("excerpt"),
        blank_if_null(joined_parts(F.col("_doc.details.parts"), max_chars)).alias("content"),
        parse_instant(F.col("_doc.updated_at"), as_of).alias("published_at"))


def stored_flags(c: Column) -> Column:
    return split_list(c)
