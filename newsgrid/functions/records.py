"""Semi-structured records: lenient JSON, scorer output, entity structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgrid.functions.arrays import let
from newsgrid.functions.numbers import clamp, round_half_even
from newsgrid.functions.text import blank_if_null
from newsgrid.schemas import ENTITIES, INCIDENT_TYPES, SEVERITIES


def parse_entities(text: Column) -> Column:
    """JSON text to ``struct<persons, orgs, places>``; bad text and missing keys give empty lists."""
    parsed = F.from_json(text, ENTITIES)
    none = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(parsed[k], none).alias(k) for k in ("persons", "orgs", "places")])


def object_text(reply: Column) -> Column:
    """The JSON object inside a chatty reply: fences dropped, prose around it cut off."""
    trimmed = F.trim(F.regexp_replace(blank_if_null(reply), r"^\s+|\s+$", ""))
    unfenced = F.when(
        F.startswith(trimmed, F.lit("```")),
        F.trim(F.regexp_replace(F.btrim(trimmed, F.lit("`")), r"(?is)^json|\s+$", ""))
    ).otherwise(trimmed)
    bare = F.regexp_replace(unfenced, r"^\s+|\s+$", "")
    return let(bare, lambda b: F.when(F.startswith(b, F.lit("{")), b).otherwise(
        F.regexp_extract(b, r"(?s)\{.*\}", 0)))


def loose_object(reply: Column) -> Column:
    """Variant of the recovered object, null when it is not a valid JSON object."""
    return let(object_text(reply), lambda t: F.when(
        F.startswith(t, F.lit("{")), F.try_parse_json(t)))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def truthy(text: Column) -> Column:
    """Booleans, including the words ``true``/``yes``/``1``; everything else is false."""
    return F.lower(F.trim(blank_if_null(text))).isin("true", "yes", "1")


def coerce_assessment(v: Column, fallback_title: Column, model: str) -> Column:
    """Check and normalise a scorer's answer; null when there was none."""
    return let(v, lambda answer: _coerced(answer, fallback_title, model))


def _coerced(v: Column, fallback_title: Column, model: str) -> Column:
    kind = F.lower(F.trim(_text(v, "$.incident_type")))
    severity = F.lower(F.trim(_text(v, "$.severity")))
    confidence = clamp(F.coalesce(
        F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0)), 0.0, 1.0)
    raw_list = F.try_variant_get(v, "$.flags", "array<string>")
    raw_one = F.try_variant_get(v, "$.flags", "string")
    flags = F.coalesce(raw_list, F.when(raw_one.isNotNull(), F.array(raw_one)),
                       F.array().cast("array<string>"))
    flags = F.slice(F.transform(
        F.filter(flags, lambda f: F.trim(blank_if_null(f)) != ""),
        lambda f: F.lower(F.trim(f))), 1, 8)
    summary = _text(v, "$.summary")
    return F.when(v.isNotNull(), F.struct(
        truthy(_text(v, "$.is_incident")).alias("is_incident"),
        F.when(kind.isin(*INCIDENT_TYPES), kind).otherwise(F.lit("info")).alias("incident_type"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise(F.lit("low")).alias("severity"),
        F.substring(_text(v, "$.severity_reasoning"), 1, 500).alias("severity_reasoning"),
        F.substring(F.when(summary != "", summary).otherwise(fallback_title), 1, 500)
        .alias("summary"),
        F.substring(_text(v, "$.location_hint"), 1, 300).alias("location_hint"),
        truthy(_text(v, "$.is_followup")).alias("is_followup"),
        round_half_even(confidence, 2).alias("confidence"),
        flags.alias("flags"),
        F.lit(model).alias("model"),
        F.lit(False).alias("used_fallback")))


def joined_parts(parts: Column, max_chars: int | None = None) -> Column:
    """``array<struct<title, body>>`` to one text: a heading per part, empty bodies skipped."""
    from newsgrid.functions.text import strip_tags

    clean = F.transform(parts, lambda p: F.struct(
        blank_if_null(p["title"]).alias("title"), strip_tags(p["body"]).alias("body")))
    kept = F.filter(clean, lambda p: p["body"] != "")
    text = F.array_join(F.transform(
        kept, lambda p: F.concat(F.lit("## "), p["title"], F.lit("\n"), p["body"])), "\n\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)
