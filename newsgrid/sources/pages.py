"""Raw HTML pages to article and link rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.arrays import evaluate_once, let
from newsgrid.functions.dates import instant, last_updated_date, reissue_date
from newsgrid.functions.html import (
    DEFAULT_CONTAINERS, absolute_url, container_html, page_body, page_excerpt, page_links,
    page_published, page_title,
    time_attribute,
)
from newsgrid.functions.text import blank_if_null, strip_tags, with_level
from newsgrid.operators.dedupe import first_per_url


def page_host(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")),
                            r"^www\.", "")


def extract_pages(pages: DataFrame, as_of, containers: Sequence[str] = DEFAULT_CONTAINERS,
                  max_chars: int | None = None) -> DataFrame:
    """``pages(page_id, url, html, title?, excerpt?, published?)`` to article rows.

    Fields a feed already gave win over the page.  Pages without a title are
    dropped.
    """
    def given(name):
        return F.col(name) if name in pages.columns else None
    html = F.col("html")
    fields = evaluate_once(
        pages, title=page_title(html, given("title")), excerpt=page_excerpt(html, given("excerpt")),
        published_at=page_published(html, as_of, given("published")),
        content=page_body(html, containers, max_chars), source=page_host(F.col("url")))
    return fields.filter(F.col("title") != "").drop("html", "published")


def page_link_rows(pages: DataFrame, pattern: str | None = None, min_label: int = 20) -> DataFrame:
    """``page_id, pos, url, label`` of links; with ``pattern`` only matching, well-labelled ones."""
    rows = pages.select("page_id", F.col("url").alias("_page"),
                        F.posexplode(page_links(F.col("html"))).alias("pos", "_a"))
    rows = rows.filter(F.col("_a.href") != "")
    if pattern:
        rows = rows.filter(F.rlike(F.col("_a.href"), F.lit(pattern))
                           & (F.length("_a.label") > min_label))
    return rows.select("page_id", "pos", absolute_url(F.col("_a.href"), F.col("_page"))
                       .alias("url"), F.col("_a.label").alias("label"))


def feed_then_pages(feed_rows: DataFrame, page_rows: DataFrame, order: Sequence[str] = ("pos",)
                    ) -> DataFrame:
    """Feed rows before page rows, one row per URL across both."""
    both = feed_rows.withColumn("_src", F.lit(0)).unionByName(
        page_rows.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_per_url(both, [F.asc("_src"), *[F.asc(c) for c in order]]).drop("_src")


@dataclass(frozen=True)
class AdvisoryRule:
    """How one issuer's advisory page is read."""

    issuer: str
    title: str
    title_from: str | None = None     # element whose text follows title_prefix, if present
    title_prefix: str = ""
    level: Sequence[str] = ()         # elements that may hold the level badge
    level_pattern: str | None = None  # or a pattern over the page text
    level_max: int | None = None
    level_shorter_than: int | None = None
    body: Sequence[str] = ("main", "article")
    dated: str | None = None          # "reissued", "last_updated", "time" or None
    excerpt: str | None = None        # fixed text before the level, instead of the description
    excerpt_from_body: bool = False


def advisory_pages(pages: DataFrame, rules: Sequence[AdvisoryRule], as_of,
                   issuer: str = "issuer") -> DataFrame:
    """Pages of each issuer by its own rule, all in one pass over the pages.

    Every rule is a literal expression under a condition on the issuer, so only
    the rule of a page's issuer is evaluated and patterns are compiled once.
    """
    if not rules:
        raise ValueError("no advisory rules given")
    html = F.col("html")

    def read(rule: AdvisoryRule) -> Column:
        badge = strip_tags(F.coalesce(*[container_html(html, s) for s in rule.level], F.lit("")))
        if rule.level_pattern:
            badge = F.regexp_extract(strip_tags(html), rule.level_pattern, 1)
        head = strip_tags(container_html(html, rule.title_from)) if rule.title_from else F.lit("")
        found = F.struct(page_body(html, rule.body).alias("content"), badge.alias("badge"),
                         page_excerpt(html).alias("meta"), head.alias("head"),
                         time_attribute(html).alias("time"))
        return let(found, lambda x: article(rule, x))

    def article(rule: AdvisoryRule, x: Column) -> Column:
        when = {"reissued": reissue_date, "last_updated": last_updated_date,
                "time": lambda _: F.try_to_timestamp(x["time"])}.get(rule.dated)
        published = instant(as_of)
        if when is not None:
            published = F.coalesce(when(x["content"]), published)
        excerpt = x["meta"]
        if rule.excerpt is not None:
            excerpt = F.trim(F.concat(F.lit(rule.excerpt + " "), x["badge"]))
        elif rule.excerpt_from_body:
            excerpt = F.when(excerpt != "", excerpt).otherwise(F.substring(x["content"], 1, 280))
        title = F.when(x["head"] != "", F.concat(F.lit(rule.title_prefix), x["head"])).otherwise(
            F.lit(rule.title))
        return F.struct(
            with_level(title, x["badge"], rule.level_max, rule.level_shorter_than).alias("title"),
            blank_if_null(excerpt).alias("excerpt"), x["content"].alias("content"),
            published.cast("timestamp").alias("published_at"), F.lit(rule.issuer).alias("source"))

    mine = pages.filter(F.col(issuer).isin(*[r.issuer for r in rules]))
    row = F.coalesce(*[F.when(F.col(issuer) == r.issuer, read(r)) for r in rules])
    names = ("title", "excerpt", "content", "published_at", "source")
    rest = [c for c in pages.columns if c != "html" and c not in names]
    return evaluate_once(mine, _row=row).select(*rest, *[F.col(f"_row.{c}") for c in names])
