"""Reading article fields out of raw HTML with JVM regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from newsgrid.functions.arrays import let
from newsgrid.functions.dates import instant
from newsgrid.functions.text import blank_if_null, decode_references, strip_tags


def _found(c: Column) -> Column:
    """Blank and null both mean "not there"."""
    return F.when(F.trim(blank_if_null(c)) != "", F.trim(c))


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute inside one tag."""
    return F.regexp_extract(tag, rf"(?is)\b{re.escape(name)}\s*=\s*(['\"])(.*?)\1", 2)


def meta_content(html: Column, key: str) -> Column:
    """``content`` of the first ``<meta>`` whose property or name is ``key``."""
    tag = F.regexp_extract(
        html, rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*['\"]{re.escape(key)}['\"][^>]*>", 0)
    return _found(decode_references(attribute(tag, "content")))


def page_title(html: Column, given: Column | None = None) -> Column:
    own = _found(strip_tags(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    options = [meta_content(html, "og:title"), own]
    return F.coalesce(*([_found(given)] if given is not None else []), *options, F.lit(""))


def page_excerpt(html: Column, given: Column | None = None) -> Column:
    options = [meta_content(html, "og:description"), meta_content(html, "description")]
    return F.coalesce(*([_found(given)] if given is not None else []), *options, F.lit(""))


def time_attribute(html: Column) -> Column:
    """``datetime`` of the first ``<time>``, null when absent."""
    return _found(attribute(F.regexp_extract(html, r"(?is)<time\b[^>]*>", 0), "datetime"))


def page_published(html: Column, as_of, given: Column | None = None) -> Column:
    """JSON-LD, then three meta names, then the first ``<time>``, then ``as_of``."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))
    dated = F.transform(blocks, lambda b: F.coalesce(
        F.get_json_object(b, "$.datePublished"), F.get_json_object(b, "$[0].datePublished")))
    linked = F.get(F.filter(dated, lambda d: d.isNotNull() & (d != "")), 0)
    options = [linked, meta_content(html, "article:published_time"),
               meta_content(html, "datePublished"), meta_content(html, "pubdate"),
               time_attribute(html)]
    if given is not None:
        options.insert(0, _found(given))
    return F.coalesce(F.try_to_timestamp(F.coalesce(*options)), instant(as_of))


# Article containers tried in order when a source names none.
DEFAULT_CONTAINERS = (
    "div.article-body", "div.article-content", "div.post-content", "div.entry-content",
    "div.story-body", "div[itemprop='articleBody']", "article",
)

_SELECTOR = re.compile(
    r"^(?P<tag>[a-z][a-z0-9]*)?(?:\.(?P<cls>[\w-]+))?(?:#(?P<id>[\w-]+))?"
    r"(?:\[(?P<attr>[\w-]+)(?P<part>\*)?='?(?P<val>[^'\]]*)'?\])?$")


def opening_pattern(selector: str) -> tuple[str, str]:
    """(regular expression of the opening tag, tag name) for a one-step selector."""
    m = _SELECTOR.match(selector.strip())
    if not m:
        raise ValueError(f"unsupported container selector: {selector!r}")
    tag = m["tag"] or r"\w+"
    need = ""
    if m["cls"]:
        need += rf"(?=[^>]*\bclass\s*=\s*['\"](?:[^'\"]*\s)?{re.escape(m['cls'])}(?:\s[^'\"]*)?['\"])"
    if m["id"]:
        need += rf"(?=[^>]*\bid\s*=\s*['\"]{re.escape(m['id'])}['\"])"
    if m["attr"]:
        some = r"[^'\"]*" if m["part"] else ""  # *= asks for a part of the value
        need += (rf"(?=[^>]*\b{re.escape(m['attr'])}\s*=\s*['\"]{some}{re.escape(m['val'])}"
                 rf"{some}['\"])")
    return rf"(?is)<({tag})\b{need}[^>]*>", tag


def container_html(html: Column, selector: str) -> Column:
    """Inner HTML of the first element a selector names; null when absent.

    Nested elements of the same name are followed to the matching end tag by
    folding over the start and end tags behind the opening one.
    """
    opening, tag = opening_pattern(selector)
    # The opening tag and everything behind it, in one match.
    found = F.regexp_extract(html, opening + "(.*)$", 0)

    def inner(rest: Column) -> Column:
        name = F.lower(F.regexp_extract(rest, r"^<(\w+)", 1)) if tag == r"\w+" else F.lit(tag)
        tail = F.regexp_replace(rest, r"^<[^>]*>", "")
        # Only tags named like the container can close it, so cut at those.
        bits = F.split(tail, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))

        def step(acc, bit):
            opens = F.lower(F.regexp_extract(bit, r"^<(\w+)", 1)) == name
            closes = F.lower(F.regexp_extract(bit, r"^</(\w+)", 1)) == name
            depth = F.when(acc["depth"] > 0, acc["depth"] + opens.cast("int")
                           - closes.cast("int")).otherwise(0)
            kept = acc["kept"] + F.when(depth > 0, F.length(bit)).otherwise(0)
            return F.struct(depth.alias("depth"), kept.alias("kept"))

        return let(tail, lambda t: F.substring(t, F.lit(1), F.aggregate(
            bits, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept")), step)["kept"]))

    return let(found, lambda f: F.when(f != "", inner(f)))


def page_body(html: Column, containers: Sequence[str] = DEFAULT_CONTAINERS,
              max_chars: int | None = None) -> Column:
    """Text of the first listed container that is present, blank when none is."""
    chosen = F.coalesce(*[container_html(html, s) for s in containers], F.lit(""))
    text = strip_tags(chosen)
    return text if max_chars is None else F.substring(text, 1, max_chars)


def page_links(html: Column) -> Column:
    """``array<struct<href, label>>`` of every anchor, in page order."""
    value = r"(?:'[^']*+'|\"[^\"]*+\"|[^\s'\">]++)"
    anchors = F.regexp_extract_all(
        html, F.lit(rf"(?is)<a\b[^>]*?\bhref\s*=\s*{value}[^>]*>.*?</a\s*>"), F.lit(0))

    def href(a: Column) -> Column:
        raw = F.regexp_extract(a, rf"(?is)\bhref\s*=\s*({value})", 1)
        return decode_references(F.btrim(raw, F.lit("'\"")))

    return F.transform(anchors, lambda a: F.struct(
        href(a).alias("href"), strip_tags(a).alias("label")))


def absolute_url(href: Column, page_url: Column) -> Column:
    """Resolve a link against the site root; links of another scheme stay as they are."""
    scheme = F.coalesce(F.try_parse_url(page_url, F.lit("PROTOCOL")), F.lit("https"))
    host = F.coalesce(F.try_parse_url(page_url, F.lit("HOST")), F.lit(""))
    root = F.concat(scheme, F.lit("://"), host)
    return (F.when(blank_if_null(href) == "", F.lit(""))
            .when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
            .otherwise(F.concat(root, F.lit("/"), F.regexp_replace(
                href, r"^/?(?:\.{1,2}(?:/|$))*+/?", ""))))
