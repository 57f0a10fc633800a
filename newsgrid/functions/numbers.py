"""Small arithmetic expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted_score(topic_hits: Column, verb_hits: Column,
                   topic_weight: float = 0.20, verb_weight: float = 0.40) -> Column:
    return F.least(F.lit(1.0), topic_hits * topic_weight + verb_hits * verb_weight)


def percent(part: Column, whole: Column) -> Column:
    """Rounded whole percentage; 0 when there is nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole)).otherwise(F.lit(0.0))


def squared_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return (lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2)


def inside(lat: Column, lng: Column, min_lat, min_lng, max_lat, max_lng) -> Column:
    """Inclusive box test."""
    return lat.between(min_lat, max_lat) & lng.between(min_lng, max_lng)


def box_around(lat: Column, lng: Column, pad: float = 0.35) -> Column:
    return F.struct((lat - pad).alias("min_lat"), (lng - pad).alias("min_lng"),
                    (lat + pad).alias("max_lat"), (lng + pad).alias("max_lng"))


def round_half_even(c: Column, digits: int) -> Column:
    """Half-even rounding judged on the binary value, not on its decimal print."""
    scale = float(10 ** digits)
    return F.bround(c * F.lit(scale)) / F.lit(scale)
