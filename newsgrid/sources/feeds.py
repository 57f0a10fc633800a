"""Atom and RSS items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrid.functions.dates import parse_instant
from newsgrid.functions.text import blank_if_null

_LINK = "struct<_VALUE:string,_href:string>"
_TEXT = "string"
ITEM = (f"link {_LINK}, title {_TEXT}, summary {_TEXT}, description {_TEXT}, "
        f"published {_TEXT}, updated {_TEXT}, pubDate {_TEXT}")


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Feed files as one row per ``item`` or ``entry``."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(ITEM).load(path)


def parse_items(items: DataFrame, xml: str = "xml") -> DataFrame:
    """Item fragments held in a column; malformed ones give null fields."""
    parsed = items.withColumn("_item", F.from_xml(F.col(xml), ITEM))
    return parsed.select(*[c for c in items.columns if c != xml], "_item.*")


def feed_articles(items: DataFrame, as_of, source: str, max_excerpt: int = 500) -> DataFrame:
    """Parsed items as article rows: Atom fields first, items without a link dropped."""
    def text(*names):
        return F.coalesce(*[F.when(F.trim(blank_if_null(F.col(n))) != "", F.trim(F.col(n)))
                            for n in names], F.lit(""))
    link = F.coalesce(F.when(blank_if_null(F.col("link._href")) != "", F.col("link._href")),
                      F.trim(F.col("link._VALUE")), F.lit(""))
    summary = text("summary", "description")
    title = text("title")
    rest = [c for c in items.columns if c not in
            ("link", "title", "summary", "description", "published", "updated", "pubDate")]
    return (items.select(
        *rest, link.alias("url"), F.when(title == "", "(untitled)").otherwise(title).alias("title"),
        F.substring(summary, 1, max_excerpt).alias("excerpt"), summary.alias("content"),
        parse_instant(text("published", "pubDate", "updated"), as_of).alias("published_at"),
        F.lit(source).alias("source")).filter(F.col("url") != ""))
