"""Reference tables: gazetteer, counties with their parts, countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsgrid.functions.text import blank_if_null, slugify

GAZETTEER = "ord int, name string, lat double, lng double, specificity int"
BOX = ("min_lat", "max_lat", "min_lng", "max_lng")
COUNTRIES = ("ord int, slug string, name string, lat double, lng double, min_lat double, max_lat double, "
             "min_lng double, max_lng double")


def typed(df: DataFrame, schema: str, name: str = "name") -> DataFrame:
    """The columns of ``schema`` in their types; rows without a name are dropped.

    A missing ``ord`` ranks by name (rows of one name by a hash of the row), a missing
    ``slug`` is made from the name.
    """
    columns = dict(part.split() for part in schema.split(", "))
    for column in columns:
        if column == "slug" and column not in df.columns:
            df = df.withColumn("slug", slugify(F.col(name)))
        elif column not in df.columns and column != "ord":
            df = df.withColumn(column, F.lit(None))
    if "ord" in columns and "ord" not in df.columns:
        # A reference table is a short administrative list.
        order = Window.orderBy(F.col(name), F.xxhash64(*df.columns))
        df = df.withColumn("ord", F.row_number().over(order) - 1)
    return df.filter(F.trim(blank_if_null(F.col(name))) != "").select(
        *[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def gazetteer_table(df: DataFrame) -> DataFrame:
    return typed(df, GAZETTEER)


def country_table(df: DataFrame) -> DataFrame:
    return typed(df, COUNTRIES)


def county_table(rows: DataFrame, county: str, sub: str) -> DataFrame:
    """``slug, name, subs``: one row a county from (county, subcounty) rows, parts by name.

    Where the rows have a centre or a box, the county has the mean centre and the box
    around all its parts, as snapping needs them.
    """
    part = F.struct(F.col(sub).alias("name"), slugify(F.col(sub)).alias("slug"))
    whole = {"lat": F.avg, "lng": F.avg, "min_lat": F.min, "max_lat": F.max, "min_lng": F.min, "max_lng": F.max}
    placed = [how(F.col(c).cast("double")).alias(c) for c, how in whole.items() if c in rows.columns]
    return (rows.groupBy(F.col(county).alias("name"))
            .agg(F.array_sort(F.collect_list(part)).alias("subs"), *placed)
            .select(slugify(F.col("name")).alias("slug"), "name", "subs", *[c for c in whole if c in rows.columns]))
