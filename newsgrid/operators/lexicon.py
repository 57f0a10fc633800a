"""Term tables and matching them against text.

Small vocabularies are turned into literal expressions, so matching needs no
shuffle.  Vocabularies beyond that size are matched by an index of anchors and a
join, where Spark broadcasts the index only if its size allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.arrays import let, strings
from newsgrid.functions.text import (
    count_among, is_phrase, odd_word_total, substring_count, substring_total,
    word_hits, words_of,
)

Categories = Mapping[str, Sequence[str]]

# Literal expressions stay reasonable up to here; larger tables take the join.
LITERAL_LIMIT = 5000

# How many characters on either side of a gap make an anchor, the longest that fits first.
REACHES = (5, 3, 1)
# Phrases up to this number, and anchors up to that, are looked for in place.
DIRECT, SIEVE = 64, 256
PLAIN = r"^[\p{L}\p{N}_]+$"
_GAP = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class IncidentLexicon:
    """Vocabulary of the incident classifier.  Category order breaks ties."""

    topics: Categories
    verbs: Categories
    excluded: Sequence[str] = ()
    excluded_patterns: Sequence[str] = ()
    metaphors: Sequence[str] = ()
    severe: Sequence[str] = ()
    moderate: Sequence[str] = ()
    rescue: Sequence[str] = ()
    headline: Sequence[str] = ()
    cues: Sequence[str] = ()


@dataclass(frozen=True)
class ArticleLexicon:
    """Vocabulary of article enrichment."""

    valence: Mapping[str, float] = field(default_factory=dict)
    left: Sequence[str] = ()
    right: Sequence[str] = ()
    topics: Categories = field(default_factory=dict)
    stop: Sequence[str] = ()


def table_rows(df: DataFrame, limit: int = LITERAL_LIMIT) -> list:
    """Rows of a small reference table; refuses a table that is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"reference table has more than {limit} rows; use the join form")
    return rows


def lexicon_categories(lexicon: DataFrame, kind: str) -> dict[str, list[str]]:
    """``lexicon(kind, category, ord, term)`` rows of one kind as ordered categories."""
    rows = table_rows(lexicon.filter(F.col("kind") == kind)
                      .select("category", "ord", "term"))
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(row["category"], []).append(row["term"])
    return out


def split_terms(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    """(whole words, phrases)."""
    return [t for t in terms if not is_phrase(t)], [t for t in terms if is_phrase(t)]


def all_words(*tables: Categories) -> list[str]:
    found: dict[str, None] = {}
    for table in tables:
        for terms in table.values():
            found.update(dict.fromkeys(t for t in terms if not is_phrase(t)))
    return list(found)


def term_hits(text: Column, hits: Column, terms: Sequence[str]) -> Column:
    """Occurrences of mixed terms: words from the prepared ``hits``, phrases from ``text``."""
    words, phrases = split_terms(terms)
    return (count_among(hits, words) + odd_word_total(text, words)
            + substring_total(text, phrases))


def count_by_category(df: DataFrame, text: str, table: Categories, prefix: str = "n_") -> DataFrame:
    """One count column per category over a lower-cased text column."""
    prepared = df.withColumn("_hits", word_hits(F.col(text), all_words(table)))
    return prepared.select(*df.columns, *[
        term_hits(F.col(text), F.col("_hits"), terms).alias(prefix + name)
        for name, terms in table.items()])


def _joints(runs: Column, gaps: Column, key: Callable[[Column, Column, Column], Column]) -> Column:
    """``key(run before, gap, run after)`` of every gap of a text that is cut at its gaps."""
    return F.transform(gaps, lambda g, i: key(F.get(runs, i), g, F.get(runs, i + 1)))


def _around(reach: int) -> Callable[[Column, Column, Column], Column]:
    return lambda a, g, b: F.concat(F.lit(f"{reach}:"), F.right(a, F.lit(reach)), g, F.left(b, F.lit(reach)))


def _before(a: Column, g: Column, _: Column) -> Column:
    return F.concat(F.lit("b:"), F.right(a, F.lit(3)), F.left(g, F.lit(1)))


def _after(_: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("a:"), F.right(g, F.lit(1)), F.left(b, F.lit(3)))


def _whole(run: Column) -> Column:
    return F.concat(F.lit("w:"), run)


def _marks(gaps: Column) -> Column:
    """The single characters of all gaps."""
    each = F.split(F.array_join(gaps, ""), "")
    return F.transform(F.filter(F.array_distinct(each), lambda c: c != ""), lambda c: F.concat(F.lit("m:"), c))


def phrase_index(lexicon: DataFrame) -> DataFrame:
    """``anchor, category, term`` for ``category, term`` rows of phrases: one anchor a term.

    Phrases here are terms with a mark in them.  An anchor is something that each text with the term has.  Inside a term a run of
    letters between two gaps is a whole run of the text; the runs on either side of a gap
    end and begin as the text's do; at the edges a run may be part of a longer one.
    Of a term's anchors the one that the fewest terms share is taken, on ties the longest
    that doesn't reach far: few kinds of anchors are sought in a text then.
    """
    terms = (lexicon.filter(F.col("term") != "").select("category", "term").distinct()
             .select("category", "term", words_of(F.col("term")).alias("runs"),
                     F.regexp_extract_all("term", F.lit(_GAP), F.lit(0)).alias("gaps")))
    runs, gaps, last = F.col("runs"), F.col("gaps"), F.size("gaps")

    def fits(i: Column, reach: int) -> Column:
        """The gap's runs are known as far as ``reach``: inner ones wholly, outer ones if long enough."""
        return (((i > 0) | (F.length(F.get(runs, i)) >= reach))
                & ((i < last - 1) | (F.length(F.get(runs, i + 1)) >= reach)))

    def around(reach: int) -> Column:
        every = _joints(runs, gaps, _around(reach))
        return F.filter(every, lambda _, i: fits(i, reach))

    inner = F.transform(F.filter(runs, lambda _, i: (i > 0) & (i < last)), _whole)
    far, near, least = map(around, REACHES)
    both = F.concat(inner, far, F.when(F.size(near) > 0, near).otherwise(least))
    # One run at most, open to one side: the run's end with the mark behind it, or the reverse.
    first, end = F.get(runs, F.lit(0)), F.get(runs, last)
    edge = (F.when(F.length(first) >= 3, F.array(_before(first, F.get(gaps, F.lit(0)), first)))
            .when(F.length(end) >= 3, F.array(_after(end, F.get(gaps, last - 1), end)))
            .otherwise(_marks(gaps)))
    anchors = F.when(F.size(both) > 0, both).otherwise(edge)
    each = terms.select("category", "term", F.explode(F.array_distinct(anchors)).alias("anchor"))
    shared = each.groupBy("anchor").agg(F.count("*").alias("terms"))
    far = F.startswith("anchor", F.lit(f"{REACHES[0]}:"))
    return (each.join(shared, "anchor").groupBy("category", "term")
            .agg(F.min_by("anchor", F.struct("terms", far, -F.length("anchor"), "anchor")).alias("anchor"))
            .select("anchor", "category", "term"))


KINDS = (*(f"{reach}:" for reach in REACHES), "w:", "m:", "b:", "a:")


def text_anchors(text: Column, kinds: Column) -> Column:
    """The different anchors of a text whose kind is among ``kinds``."""
    def made(x: Column) -> Column:
        runs, gaps = x["runs"], x["gaps"]
        forms = {f"{reach}:": _joints(runs, gaps, _around(reach)) for reach in REACHES}
        forms |= {"w:": F.transform(runs, _whole), "m:": _marks(gaps),
                  "b:": _joints(runs, gaps, _before), "a:": _joints(runs, gaps, _after)}
        parts = [F.when(F.array_contains(x["kinds"], kind), form).otherwise(strings([]))
                 for kind, form in forms.items()]
        return F.array_distinct(F.concat(*parts))

    gaps = F.regexp_extract_all(text, F.lit(_GAP), F.lit(0))
    return let(F.struct(words_of(text).alias("runs"), gaps.alias("gaps"), kinds.alias("kinds")), made)


def phrases_maybe(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``_of`` and ``_maybe``, the phrases (``category``, ``term``) that each text may hold.

    ``texts`` has ``_doc`` and lower-cased ``_text``.  The anchors of a vocabulary of up to
    ``SIEVE`` are looked for in place first, so that other anchors don't become rows.
    """
    index = phrase_index(phrases)
    few = index.select("anchor").distinct().limit(SIEVE + 1).agg(F.collect_set("anchor")).scalar()
    prepared = texts.withColumn("_few", few)
    small = F.size("_few") <= SIEVE
    kinds = F.when(small, F.transform("_few", lambda x: F.left(x, F.lit(2)))).otherwise(strings(KINDS))
    sought = let(text_anchors(F.col("_text"), kinds), lambda found: F.when(
        small, F.array_intersect(found, F.col("_few"))).otherwise(found))
    return (prepared.select(F.col("_doc").alias("_of"), F.explode(sought).alias("anchor"))
            .join(index, "anchor").groupBy("_of").agg(F.collect_set(F.struct("category", "term")).alias("_maybe")))


def bounded(term: Column) -> Column:
    """A pattern for ``term`` between word boundaries."""
    quoted = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?U)\b\Q"), quoted, F.lit(r"\E\b"))


def category_hits_join(docs: DataFrame, doc_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``doc_id, category, hits`` for a vocabulary of words and phrases of any size.

    Words are joined on the text's words.  Phrases and texts meet by anchors
    (``phrase_index``), without the text; the phrases a text may hold are gathered and
    its text is joined to them once, where they are counted.  An anchor without its
    phrase counts nothing.  Up to ``DIRECT`` phrases are sought and counted in every
    text as it is read, and no text is shuffled.
    ``doc_id`` and ``category`` may be structs.  Rows with equal or null ``doc_id`` count together;
    null and empty texts and terms match nothing.
    """
    plain = F.rlike("term", F.lit(PLAIN))
    lowered = docs.select(F.col(doc_id).alias("_doc"), F.lower(F.col(text)).alias("_text"))
    words = (lowered.select("_doc", F.explode(words_of(F.col("_text"))).alias("term"))
             .join(lexicon.filter(plain).select("category", "term").distinct(), "term")
             .select("_doc", "category", F.lit(1).cast("long").alias("n")))
    terms = lexicon.filter(~plain & (F.col("term") != "")).select("category", "term").distinct()
    few = terms.limit(DIRECT + 1).agg(F.collect_list(F.struct("category", "term"))).scalar()

    def found(m: Column) -> Column:
        term = m["term"]
        phrase = F.contains(term, F.lit(" ")) | F.contains(term, F.lit("-"))
        return F.struct(m["category"].alias("category"),
                        F.when(phrase, substring_count(F.col("_text"), term))
                        .otherwise(F.regexp_count("_text", bounded(term))).cast("long").alias("n"))

    def counted(rows: DataFrame, sought: Column) -> DataFrame:
        return rows.select("_doc", F.inline(F.transform(sought, found))).filter("n > 0")

    in_place = counted(lowered.filter(F.size(few) <= DIRECT).withColumn("_few", few),
                       F.filter("_few", lambda m: F.contains("_text", m["term"])))
    # The filter is above the scan: with few phrases no text is taken apart or shuffled.
    rest = lowered.filter(F.size(few) > DIRECT)
    maybe = phrases_maybe(rest, terms)
    joined = counted(maybe.join(rest, F.col("_of").eqNullSafe(F.col("_doc"))), F.col("_maybe"))
    phrases = in_place.unionByName(joined)
    return (words.unionByName(phrases).groupBy(F.col("_doc").alias(doc_id), "category")
            .agg(F.sum("n").alias("hits")))


def best_category(hits: DataFrame, doc_id: str, score: str, ord_col: str) -> DataFrame:
    """Highest score per document, the earliest category on ties."""
    return (hits.groupBy(doc_id)
            .agg(F.max_by(F.struct("category", score),
                          F.struct(F.col(score), -F.col(ord_col))).alias("_best"))
            .select(doc_id, "_best.*"))
