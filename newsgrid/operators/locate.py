"""Places: gazetteer matching, candidate lookup, snapping to boundaries."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.arrays import distinct_ignoring_case, let
from newsgrid.functions.numbers import inside, squared_degrees
from newsgrid.functions.text import (
    blank_if_null, place_hint_variants, title_place_candidates, words_of,
)
from newsgrid.operators.grouped import latest_per_key
from newsgrid.operators.lexicon import PLAIN, bounded, phrases_maybe

PLACE = "struct<name:string,lat:double,lng:double,specificity:int>"


@dataclass(frozen=True)
class Home:
    """The home country: its label, slug, centre and the two boxes in use."""

    name: str
    slug: str
    lat: float
    lng: float
    snap_box: tuple[float, float, float, float]
    report_box: tuple[float, float, float, float]


# The default home country, with the box used when snapping and
# the wider one used when citizen reports are accepted.
DEFAULT_HOME = Home("Kenya", "kenya", 0.0236, 37.9062,
                    (-4.72, 33.91, 5.02, 41.91), (-5.0, 33.5, 5.0, 42.5))


def place_struct(name, lat, lng, specificity) -> Column:
    def lit(v, t):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(lit(name, "string").alias("name"), lit(lat, "double").alias("lat"),
                    lit(lng, "double").alias("lng"), lit(specificity, "int").alias("specificity"))


def home_place(home: Home) -> Column:
    return place_struct(home.name, home.lat, home.lng, 0)


# -- text against a gazetteer ------------------------------------------------

def gazetteer_match(text: Column, gazetteer: Sequence) -> Column:
    """Best listed place in a text: highest specificity, then table order; null if none.

    One regular expression looks, at every word start, for the most preferred
    name beginning there; the best of those is the best overall, also where
    names nest or overlap.
    """
    order = sorted(gazetteer, key=lambda g: (-g["specificity"], g["ord"]))
    names = F.array(*[F.lit(g["name"].lower()) for g in order])
    table = F.array(*[place_struct(g["name"], g["lat"], g["lng"], g["specificity"])
                      for g in order])
    pattern = r"(?iu)(?U)\b(?=(" + "|".join(re.escape(g["name"]) for g in order) + r")\b)"

    def pick(hits: Column) -> Column:
        best = F.array_min(F.transform(hits, lambda h: F.array_position(names, F.lower(h))))
        return F.when(F.size(hits) > 0, F.get(table, (best - 1).cast("int")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), pick)


def best_location(text: Column, gazetteer: Sequence, home: Home = DEFAULT_HOME) -> Column:
    """Null for blank text, the country centre when no listed place is named."""
    return F.when(F.trim(blank_if_null(text)) != "",
                  F.coalesce(gazetteer_match(text, gazetteer), home_place(home)))


def gazetteer_match_join(docs: DataFrame, doc_id: str, text: str,
                         gazetteer: DataFrame) -> DataFrame:
    """``doc_id, name, lat, lng, specificity`` for a gazetteer of any size.

    Names of one word are joined on the text's words.  Longer ones meet the texts by one
    anchor each (``lexicon.phrase_index``), so that what a text sends doesn't depend on the
    longest name, and are looked for in the text, which is joined to them once.
    ``doc_id`` may be a struct.  Null and empty texts and names match nothing.
    """
    lowered = docs.select(F.col(doc_id).alias("_doc"), F.lower(F.col(text)).alias("_text"))
    names = gazetteer.select(F.lower("name").alias("term"), F.struct(
        (-F.col("specificity")).alias("first"), "ord", "name", "lat", "lng", "specificity").alias("category"))
    plain = F.rlike("term", F.lit(PLAIN))
    words = (lowered.select("_doc", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("term"))
             .join(names.filter(plain), "term").select("_doc", F.col("category").alias("_p")))
    maybe = phrases_maybe(lowered, names.filter(~plain))
    there = F.filter("_maybe", lambda m: F.rlike("_text", bounded(m["term"])))
    longer = (maybe.join(lowered, F.col("_of").eqNullSafe(F.col("_doc")))
              .select("_doc", F.explode(there).alias("_m")).select("_doc", F.col("_m.category").alias("_p")))
    # The struct's order is the order of preference.
    return (words.unionByName(longer).groupBy(F.col("_doc").alias(doc_id)).agg(F.min("_p").alias("_p"))
            .select(doc_id, "_p.name", "_p.lat", "_p.lng", "_p.specificity"))


# -- candidate lookup --------------------------------------------------------

def place_candidates(hint: Column, title: Column, stop_words: Sequence[str]) -> Column:
    """The hint first, then title spans, distinct case-insensitively."""
    hint_list = F.when(F.trim(blank_if_null(hint)) != "", F.array(F.trim(hint))).otherwise(
        F.array().cast("array<string>"))
    return distinct_ignoring_case(F.concat(hint_list, title_place_candidates(
        blank_if_null(title), stop_words)))


def lookup_candidates(df: DataFrame, row_id: str, candidates: str, places: DataFrame) -> DataFrame:
    """``row_id, name, lat, lng`` of the first candidate a place table knows.

    Each candidate is tried in its hint variants before the next one.  The table
    is joined on its lower-cased name; Spark broadcasts it only if it is small.
    """
    tried = (df.select(row_id, F.posexplode(candidates).alias("_word_pos", "_word"))
             .select(row_id, "_word_pos", "_word",
                     F.posexplode(place_hint_variants(F.col("_word"))).alias("_form_pos", "_form")))
    known = (places.select(F.lower("name").alias("_key"), "lat", "lng")
             .groupBy("_key").agg(F.min_by(F.struct("lat", "lng"), F.struct("lat", "lng"))
                                  .alias("_at")))
    hits = tried.withColumn("_key", F.lower("_form")).join(known, "_key")
    return (hits.groupBy(row_id)
            .agg(F.min_by(F.struct(F.col("_word").alias("name"), F.col("_at.lat").alias("lat"),
                                   F.col("_at.lng").alias("lng")),
                          F.struct("_word_pos", "_form_pos")).alias("_p"))
            .select(row_id, "_p.*"))


def _vague(place: Column, home: Home) -> Column:
    return place.isNull() | (place["name"] == home.name)


def _with_hint(text: Column, hint: Column, named: Column, hinted: Column, home: Home) -> Column:
    """The place for what a text and a hint name; a hint helps out when the text only gives the country."""
    found = F.when(F.trim(blank_if_null(text)) != "", F.coalesce(named, home_place(home)))
    told = F.when(F.trim(blank_if_null(hint)) != "", hinted)
    return let(found, lambda f: F.when(_vague(f, home), F.coalesce(told, f)).otherwise(f))


def match_place(df: DataFrame, row_id: str, text: Column, hint: Column, gazetteer: Sequence | DataFrame,
                home: Home = DEFAULT_HOME, loc: str = "_loc") -> DataFrame:
    """Add ``loc``: the best listed place of a text, or of the hint if the text only gives the country.

    A gazetteer that is a table is joined, with texts and hints in one pass; ``row_id`` is
    then not null and unique.
    """
    if not isinstance(gazetteer, DataFrame):
        return df.withColumn(loc, _with_hint(text, hint, gazetteer_match(text, gazetteer),
                                             gazetteer_match(hint, gazetteer), home))
    said = df.select(F.col(row_id).alias("_row"), F.inline(F.array(
        F.struct(F.lit("text").alias("_part"), text.alias("_said")),
        F.struct(F.lit("hint").alias("_part"), hint.alias("_said")))))
    hits = gazetteer_match_join(said.select(F.struct("_row", "_part").alias("_key"), "_said"), "_key", "_said", gazetteer)
    place = place_struct(F.col("name"), F.col("lat"), F.col("lng"), F.col("specificity"))
    both = hits.groupBy(F.col("_key._row").alias(row_id)).agg(
        *[F.max(F.when(F.col("_key._part") == p, place)).alias(f"_{p}_place") for p in ("text", "hint")])
    return (df.join(both, row_id, "left")
            .withColumn(loc, _with_hint(text, hint, F.col("_text_place"), F.col("_hint_place"), home))
            .drop("_text_place", "_hint_place"))


def look_up_place(df: DataFrame, row_id: str, loc: str, hint: Column, title: Column,
                  places: DataFrame | None, stop_words: Sequence[str] = (),
                  home: Home = DEFAULT_HOME) -> DataFrame:
    """Replace ``loc`` by ``place`` and ``location_fallback``.

    Rows that are still vague try their candidates against the place table; a
    hit has specificity 1, and without any place the country centre is used.
    """
    if places is not None:
        vague = df.filter(_vague(F.col(loc), home)).select(
            row_id, place_candidates(hint, title, stop_words).alias("_cands"))
        found = lookup_candidates(vague, row_id, "_cands", places).select(
            row_id, place_struct(F.col("name"), F.col("lat"), F.col("lng"), 1).alias("_found"))
        df = df.join(found, row_id, "left")
    else:
        df = df.withColumn("_found", F.lit(None).cast(PLACE))
    place = F.coalesce("_found", loc, home_place(home))
    fallback = F.col("_found").isNotNull() | F.col(loc).isNull()
    return (df.withColumn("place", place).withColumn("location_fallback", fallback)
            .drop(loc, "_found"))


def resolve_location(df: DataFrame, row_id: str, text: Column, hint: Column, title: Column,
                     gazetteer: Sequence | DataFrame, places: DataFrame | None,
                     stop_words: Sequence[str] = (), home: Home = DEFAULT_HOME) -> DataFrame:
    """Add ``place`` and ``location_fallback``.

    Precedence: a listed place in the text, a listed place in the hint, the first
    candidate the place table knows, the country centre.  The gazetteer is a short list
    or a table of any size.
    """
    matched = match_place(df, row_id, text, hint, gazetteer, home)
    return look_up_place(matched, row_id, "_loc", hint, title, places, stop_words, home)


# -- boundaries --------------------------------------------------------------

def in_home(lat: Column, lng: Column, box) -> Column:
    return inside(lat, lng, *[F.lit(v) for v in box])


def nearest_county(lat: Column, lng: Column, counties: Sequence) -> Column:
    """``struct<slug, name, lat, lng>`` of the closest centroid, first listed on ties.

    The county table is a short administrative list, so it is compared in place
    instead of being joined to every row.
    """
    table = F.array(*[F.struct(
        F.lit(c["ord"]).alias("ord"), F.lit(c["slug"]).alias("slug"), F.lit(c["name"]).alias("name"),
        F.lit(float(c["lat"])).alias("lat"), F.lit(float(c["lng"])).alias("lng"))
        for c in counties])
    ranked = F.transform(table, lambda c: F.struct(
        squared_degrees(lat, lng, c["lat"], c["lng"]).alias("d"), c["ord"].alias("ord"),
        c["slug"].alias("slug"), c["name"].alias("name"),
        c["lat"].alias("lat"), c["lng"].alias("lng")))
    return F.array_min(ranked)


def containing_counties(points: DataFrame, counties: DataFrame, lat: str, lng: str,
                        cell: float = 1.0) -> DataFrame:
    """Every (point, county) pair where the county box holds the point.

    Boxes are listed per grid cell and joined on the cell, so neither side is
    multiplied by the whole other side.
    """
    cells = (counties
             .withColumn("_cy", F.explode(F.sequence(
                 F.floor(F.col("min_lat") / cell), F.floor(F.col("max_lat") / cell))))
             .withColumn("_cx", F.explode(F.sequence(
                 F.floor(F.col("min_lng") / cell), F.floor(F.col("max_lng") / cell))))
             .select("_cy", "_cx", F.col("slug").alias("county_slug"),
                     F.col("name").alias("county_name"),
                     "min_lat", "min_lng", "max_lat", "max_lng"))
    located = (points.withColumn("_cy", F.floor(F.col(lat) / cell))
               .withColumn("_cx", F.floor(F.col(lng) / cell)))
    hit = inside(F.col(lat), F.col(lng), F.col("min_lat"), F.col("min_lng"),
                 F.col("max_lat"), F.col("max_lng"))
    return (located.join(cells, ["_cy", "_cx"]).filter(hit)
            .select(*points.columns, "county_slug", "county_name"))


SNAP = ("struct<lat:double,lng:double,name:string,precision:string,country:string,"
        "county:string,subcounty:string,in_bounds:boolean>")


def snap_location(df: DataFrame, counties: DataFrame, countries: DataFrame,
                  lat: str = "latitude", lng: str = "longitude", country: str = "country",
                  county: str = "county", subcounty: str = "subcounty",
                  home: Home = DEFAULT_HOME) -> DataFrame:
    """Add ``snap``: where the picked country, county and subcounty put the point.

    Null when a slug is unknown or only a subcounty pick could decide.
    """
    pick = F.when(blank_if_null(F.col(country)) == "", F.lit(home.slug)).otherwise(F.col(country))
    rows = (df.withColumn("_country", pick)
            .withColumn("_county", blank_if_null(F.col(county)))
            .withColumn("_sub", blank_if_null(F.col(subcounty))))
    land = countries.select(
        F.col("slug").alias("_country"), F.col("name").alias("_c_name"),
        F.col("lat").alias("_c_lat"), F.col("lng").alias("_c_lng"),
        F.struct("min_lat", "min_lng", "max_lat", "max_lng").alias("_c_box"))
    area = counties.select(
        F.col("slug").alias("_county"), F.struct(*[c for c in counties.columns]).alias("_k"))
    rows = rows.join(land, "_country", "left").join(area, "_county", "left")

    y, x = F.col(lat), F.col(lng)
    box, k = F.col("_c_box"), F.col("_k")
    in_country = F.when(
        box["min_lat"].isNull(), F.lit(True)).otherwise(inside(
            y, x, box["min_lat"], box["min_lng"], box["max_lat"], box["max_lng"]))
    sub = F.get(F.filter(k["subs"], lambda s: s["slug"] == F.col("_sub")), 0)
    in_county = inside(y, x, k["min_lat"], k["min_lng"], k["max_lat"], k["max_lng"])

    def snap(la, ln, name, precision, ctry, cty, sb, ok) -> Column:
        def text(v):
            return v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            la.cast("double").alias("lat"), ln.cast("double").alias("lng"),
            text(name).alias("name"), F.lit(precision).alias("precision"),
            text(ctry).alias("country"), text(cty).alias("county"), text(sb).alias("subcounty"),
            text(ok).alias("in_bounds"))

    at_country = snap(F.when(in_country, y).otherwise(F.col("_c_lat")),
                      F.when(in_country, x).otherwise(F.col("_c_lng")),
                      F.col("_c_name"), "country", F.col("_country"), "", "", in_country)
    at_sub = snap(sub["lat"], sub["lng"], F.concat(sub["name"], F.lit(", "), k["name"]),
                  "subcounty", home.slug, k["slug"], sub["slug"], True)
    kept = snap(y, x, k["name"], "exact", home.slug, k["slug"], "", True)
    centred = snap(k["lat"], k["lng"], k["name"], "county", home.slug, k["slug"], "", False)

    at_home = F.col("_country") == home.slug
    decided = (
        F.when(~at_home | (F.col("_county") == ""),
               F.when(F.col("_c_name").isNotNull(), at_country))
        .when(k.isNull(), F.lit(None))
        .when((F.col("_sub") != "") & sub.isNotNull(), at_sub)
        .when(in_county, kept)
        .when(F.coalesce(F.size(k["subs"]), F.lit(0)) <= 0, centred))
    return rows.withColumn("snap", decided).select(*df.columns, "snap")


def apply_snap(df: DataFrame, snap: str = "snap", country: str = "country", county: str = "county",
               subcounty: str = "subcounty", home: Home = DEFAULT_HOME) -> DataFrame:
    """Write snaps onto incidents; without one only the picks are recorded.

    An exact or subcounty result clears the review flag.
    """
    s = F.col(snap)
    got = s.isNotNull()

    def keep(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def picked(pick: str, name: str) -> Column:
        return F.when(blank_if_null(F.col(pick)) != "", F.col(pick)).otherwise(keep(name))

    new = {
        "latitude": F.when(got, s["lat"]).otherwise(F.col("latitude")),
        "longitude": F.when(got, s["lng"]).otherwise(F.col("longitude")),
        "location_name": F.when(got, s["name"]).otherwise(keep("location_name")),
        "location_country": F.when(got, s["country"]).otherwise(
            F.when(blank_if_null(F.col(country)) != "", F.col(country)).otherwise(home.slug)),
        "location_county": F.when(got, s["county"]).otherwise(picked(county, "location_county")),
        "location_subcounty": F.when(got, s["subcounty"]).otherwise(
            picked(subcounty, "location_subcounty")),
        "location_precision": F.when(got, s["precision"]).otherwise(keep("location_precision")),
        "needs_review": F.when(s["precision"].isin("exact", "subcounty"), False).otherwise(
            F.col("needs_review")),
    }
    return df.withColumns(new).drop(snap)


def _at_nearest(df: DataFrame, where: Column, counties: Sequence, home: Home) -> DataFrame:
    near = F.when(where, nearest_county(F.col("latitude"), F.col("longitude"), counties))
    moved = df.withColumn("_near", near)
    n = F.col("_near")

    def keep(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return moved.withColumns({
        "latitude": F.coalesce(n["lat"], F.col("latitude")),
        "longitude": F.coalesce(n["lng"], F.col("longitude")),
        "location_name": F.coalesce(n["name"], keep("location_name")),
        "location_county": F.coalesce(n["slug"], keep("location_county")),
        "location_precision": F.when(n.isNotNull(), "county").otherwise(keep("location_precision")),
        "needs_review": F.when(n.isNotNull(), True).otherwise(F.col("needs_review")),
    })


def has_point(df: DataFrame) -> Column:
    """(0, 0) and missing coordinates mean "no coordinates"."""
    lat, lng = F.coalesce("latitude", F.lit(0.0)), F.coalesce("longitude", F.lit(0.0))
    return ~((lat == 0.0) & (lng == 0.0))


def auto_snap_out_of_bounds(df: DataFrame, counties: Sequence,
                            home: Home = DEFAULT_HOME) -> DataFrame:
    """Home incidents outside the box move to the nearest county centroid and need review.

    Incidents tagged to another country only get a missing precision label.
    """
    country = F.when(blank_if_null(F.col("location_country")) == "", F.lit(home.slug)).otherwise(
        F.col("location_country"))
    marked = df.withColumn("_foreign", country != home.slug)
    outside = (has_point(df) & ~F.col("_foreign")
               & ~in_home(F.col("latitude"), F.col("longitude"), home.snap_box))
    out = _at_nearest(marked, outside, counties, home)
    label = (F.when(F.col("_foreign") & has_point(df) & F.col("location_precision").isNull(),
                    "country").otherwise(F.col("location_precision")))
    home_again = F.when(F.col("_near").isNotNull(), F.lit(home.slug)).otherwise(
        F.col("location_country"))
    return (out.withColumn("location_precision", label)
            .withColumn("location_country", home_again).drop("_foreign", "_near"))


def backfill_locations(df: DataFrame, counties: Sequence, home: Home = DEFAULT_HOME,
                       dry_run: bool = False) -> DataFrame:
    """Label inside points that lack a precision, move outside ones; adds ``backfill``.

    ``backfill`` is ``skipped``, ``ok``, ``labelled`` or ``snapped``; with
    ``dry_run`` only that column is added.
    """
    within = in_home(F.col("latitude"), F.col("longitude"), home.snap_box)
    outcome = (F.when(~has_point(df), "skipped").when(~within, "snapped")
               .when(F.col("location_precision").isNull(), "labelled").otherwise("ok"))
    marked = df.withColumn("backfill", outcome)
    if dry_run:
        return marked
    moved = _at_nearest(marked, F.col("backfill") == "snapped", counties, home).drop("_near")
    near = F.when(F.col("backfill") == "labelled", nearest_county(
        F.col("latitude"), F.col("longitude"), counties))
    out = moved.withColumn("_near", near)
    return out.withColumns({
        "location_county": F.coalesce(F.col("_near.slug"), F.col("location_county")),
        "location_precision": F.when(F.col("_near").isNotNull(), "exact").otherwise(
            F.col("location_precision")),
    }).drop("_near")


def backfill_counts(backfilled: DataFrame) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("backfill") == v)
    return backfilled.agg(
        F.count("*").alias("scanned"), is_("snapped").alias("snapped"),
        is_("snapped").alias("flagged"), is_("labelled").alias("labelled"))


def fix_requests(requests: DataFrame, incidents: DataFrame, counties: DataFrame,
                 countries: DataFrame, home: Home = DEFAULT_HOME) -> DataFrame:
    """Location edits joined to their incidents and snapped; missing incidents are dropped.

    ``requests(incident_id, country, county, subcounty)``; of several for one
    incident the latest by ``requested_at`` holds.
    """
    requests = latest_per_key(requests, "incident_id", "requested_at")
    joined = incidents.join(requests, "incident_id")
    return snap_location(joined, counties, countries, home=home)


def county_tree(counties: DataFrame) -> DataFrame:
    """``slug`` to its subcounties as ``name``/``slug`` pairs."""
    return counties.select("slug", F.transform(
        "subs", lambda s: F.struct(s["name"].alias("name"), s["slug"].alias("slug"))).alias("subs"))
