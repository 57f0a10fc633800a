"""Incident gate, classifier and pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.arrays import evaluate_once, let
from newsgrid.functions.numbers import round_half_even, weighted_score
from newsgrid.functions.records import coerce_assessment, loose_object
from newsgrid.functions.text import (
    blank_if_null, blank_out, contains_any, distinct_contained, matches_any, odd_word_total,
    word_hits,
    words_of,
)
from newsgrid.operators.lexicon import (
    IncidentLexicon, all_words, category_hits_join, split_terms, term_hits,
)

CONFIDENCE_MIN, CONFIDENCE_REVIEW = 0.30, 0.60


def hard_excluded(title_low: Column, lex: IncidentLexicon) -> Column:
    """The title alone rules the article out."""
    return contains_any(title_low, lex.excluded) | matches_any(title_low, lex.excluded_patterns)


def severity_of(text_low: Column, lex: IncidentLexicon) -> Column:
    """Distinct listed words contained in the text decide the level."""
    return let(F.struct(distinct_contained(text_low, lex.severe).alias("high"),
                        distinct_contained(text_low, lex.moderate).alias("med")),
               lambda n: F.when(n["high"] >= 2, "high")
               .when((n["high"] >= 1) | (n["med"] >= 2), "medium").otherwise("low"))


def _category_scores(title: Column, body: Column, title_hits: Column, body_hits: Column,
                     lex: IncidentLexicon) -> Column:
    """``array<struct<neg_score, ord, type>>`` of the categories that qualify."""
    scored = []
    for i, (kind, topic_terms) in enumerate(lex.topics.items()):
        verb_terms = lex.verbs.get(kind, ())
        topic = term_hits(title, title_hits, topic_terms) * 2 + term_hits(
            body, body_hits, topic_terms)
        verb = term_hits(title, title_hits, verb_terms) * 2 + term_hits(
            body, body_hits, verb_terms)
        scored.append(F.struct(topic.alias("topic"), verb.alias("verb"),
                               F.lit(i).alias("ord"), F.lit(kind).alias("type")))
    kept = F.filter(F.array(*scored), lambda c: (c["topic"] > 0) & (
        (c["verb"] > 0) | (c["topic"] >= 3)))
    return F.transform(kept, lambda c: F.struct(
        (-weighted_score(c["topic"], c["verb"])).alias("neg"),
        c["ord"].alias("ord"), c["type"].alias("type")))


def _verdict(title: Column, full: Column, top: Column, lex: IncidentLexicon) -> Column:
    """The record of the best category ``top``, null below the least confidence or if ruled out."""
    found = let(top, lambda c: F.when(-c["neg"] >= CONFIDENCE_MIN, F.struct(
        c["type"].alias("type"), severity_of(full, lex).alias("severity"),
        round_half_even(-c["neg"], 2).alias("confidence"))))
    return F.when(~hard_excluded(title, lex) & (distinct_contained(full, lex.excluded) < 2), found)


def classify(title: Column, body: Column, lex: IncidentLexicon) -> Column:
    """``struct<type, severity, confidence>`` or null when it is not an incident."""
    words = all_words(lex.topics, lex.verbs)

    def scored(t: Column, b: Column) -> Column:
        full = F.concat(t, F.lit(" "), b)

        def best(clean: Column) -> Column:
            hits = F.struct(clean["t"].alias("t"), clean["b"].alias("b"),
                            word_hits(clean["t"], words).alias("th"),
                            word_hits(clean["b"], words).alias("bh"))
            return let(hits, lambda h: F.array_min(
                _category_scores(h["t"], h["b"], h["th"], h["bh"], lex)))

        top = let(F.struct(blank_out(t, lex.metaphors).alias("t"),
                           blank_out(b, lex.metaphors).alias("b")), best)
        return _verdict(t, full, top, lex)

    lowered = F.struct(F.lower(blank_if_null(title)).alias("t"),
                       F.lower(blank_if_null(body)).alias("b"))
    return let(lowered, lambda x: scored(x["t"], x["b"]))


def classify_incidents(df: DataFrame, lex: IncidentLexicon, title: str = "title",
                       body: str = "content") -> DataFrame:
    """Add ``incident``: a struct, null for articles that are not incidents."""
    return evaluate_once(df, incident=classify(F.col(title), F.col(body), lex))


def _part_hits(df: DataFrame, key: str, parts: dict[int, Column], vocabulary: DataFrame) -> DataFrame:
    """Hits of ``vocabulary`` by ``_part`` (``key`` and weight of the part) and category (with its kind)."""
    texts = df.select(F.col(key).alias("key"), F.inline(F.array(*[
        F.struct(F.lit(weight).alias("weight"), text.alias("text")) for weight, text in parts.items()])))
    return category_hits_join(texts.select(F.struct("key", "weight").alias("_part"), "text"), "_part", "text",
                              vocabulary.select(F.struct("kind", "category").alias("category"), "term"))


def classify_incidents_join(df: DataFrame, key: str, vocabulary: DataFrame, lex: IncidentLexicon,
                            title: str = "title", body: str = "content") -> DataFrame:
    """``classify_incidents`` with topics and verbs of any number in a table.

    ``vocabulary`` has ``kind`` (topic or verb), ``category``, ``ord`` and ``term``; of
    equal scores the category wins whose topics come first.  ``key`` tells rows apart:
    rows that share one are scored together.  The short lists are taken from ``lex``.
    """
    low = {2: F.lower(blank_if_null(F.col(title))), 1: F.lower(blank_if_null(F.col(body)))}
    hits = _part_hits(df, key, {w: blank_out(t, lex.metaphors) for w, t in low.items()}, vocabulary)

    def weight(kind: str) -> Column:
        return F.sum(F.when(F.col("category.kind") == kind, F.col("hits") * F.col("_part.weight")).otherwise(0))

    scores = (hits.groupBy(F.col("_part.key").alias("_key"), F.col("category.category").alias("type"))
              .agg(weight("topic").alias("topic"), weight("verb").alias("verb"))
              .filter("topic > 0 AND (verb > 0 OR topic >= 3)"))
    orders = (vocabulary.filter("kind = 'topic'").groupBy(F.col("category").alias("type"))
              .agg(F.min("ord").alias("ord")))
    score = weighted_score(F.col("topic"), F.col("verb"))
    best = (scores.join(orders, "type").groupBy("_key")
            .agg(F.min(F.struct((-score).alias("neg"), "ord", "type")).alias("_top")))
    full = F.concat(low[2], F.lit(" "), low[1])
    found = df.join(best, df[key].eqNullSafe(best["_key"]), "left")
    return evaluate_once(found, incident=let(
        F.struct(low[2].alias("t"), full.alias("full"), F.col("_top").alias("top")),
        lambda x: _verdict(x["t"], x["full"], x["top"], lex))).select(*df.columns, "incident")


def _cascade(t: Column, b: Column, anywhere: Column, lex: IncidentLexicon) -> Column:
    # A cue in the title only adds the headline words of the body: every
    # other signal it looks for is tested by the last two rules anyway.
    cue = contains_any(t, lex.cues) & contains_any(b, lex.headline)
    return (F.when(hard_excluded(t, lex), contains_any(t, lex.rescue))
            .when(contains_any(t, lex.headline), True)
            .when(cue, True)
            .otherwise(anywhere))


def looks_like_incident(title: Column, body: Column, lex: IncidentLexicon) -> Column:
    """Inclusive gate: a cascade of cheap signals, the cheapest first."""
    both = [t for table in (lex.topics, lex.verbs) for terms in table.values() for t in terms]
    words, phrases = split_terms(list(dict.fromkeys(both)))

    def any_term(text: Column) -> Column:
        return (F.exists(words_of(text), lambda w: w.isin(*words)) if words else F.lit(False)) | (
            contains_any(text, phrases)) | (odd_word_total(text, words) > 0)

    lowered = F.struct(F.lower(blank_if_null(title)).alias("t"),
                       F.lower(blank_if_null(body)).alias("b"))
    return let(lowered, lambda x: _cascade(
        x["t"], x["b"], any_term(x["t"]) | any_term(x["b"]), lex))


def gate_incidents(df: DataFrame, lex: IncidentLexicon, title: str = "title",
                   body: str = "content", column: str | None = None) -> DataFrame:
    """Keep candidates, or only mark them when ``column`` is given."""
    passes = looks_like_incident(F.col(title), F.col(body), lex)
    return df.filter(passes) if column is None else evaluate_once(df, **{column: passes})


def gate_incidents_join(df: DataFrame, key: str, vocabulary: DataFrame, lex: IncidentLexicon,
                        title: str = "title", body: str = "content", column: str | None = None) -> DataFrame:
    """``gate_incidents`` with a ``vocabulary`` as ``classify_incidents_join`` takes it."""
    low = {2: F.lower(blank_if_null(F.col(title))), 1: F.lower(blank_if_null(F.col(body)))}
    hit = _part_hits(df, key, low, vocabulary).select(
        F.col("_part.key").alias("_key"), F.lit(True).alias("_hit")).distinct()
    marked = df.join(hit, df[key].eqNullSafe(hit["_key"]), "left")
    passes = let(F.struct(low[2].alias("t"), low[1].alias("b"), F.coalesce("_hit", F.lit(False)).alias("hit")),
                 lambda x: _cascade(x["t"], x["b"], x["hit"], lex))
    if column is None:
        return marked.filter(passes).select(*df.columns)
    return evaluate_once(marked, **{column: passes}).select(*df.columns, column)


Scorer = Callable[[Column, Column], Column]
"""(title, body) to a column of JSON text; a ``pandas_udf`` or a native expression."""


def keyword_assessment(title: Column, incident: Column) -> Column:
    """The record used when no scorer answered."""
    found = incident.isNotNull()
    return F.struct(
        found.alias("is_incident"),
        F.coalesce(incident["type"], F.lit("info")).alias("incident_type"),
        F.coalesce(incident["severity"], F.lit("low")).alias("severity"),
        F.lit("").alias("severity_reasoning"),
        F.substring(blank_if_null(title), 1, 200).alias("summary"),
        F.lit("").alias("location_hint"),
        F.lit(False).alias("is_followup"),
        F.coalesce(incident["confidence"], F.lit(0.0)).alias("confidence"),
        F.array(F.lit("llm_unavailable")).alias("flags"),
        F.lit("keyword-fallback").alias("model"),
        F.lit(True).alias("used_fallback"))


def score_incidents(df: DataFrame, lex: IncidentLexicon, scorer: Scorer | None = None,
                    title: str = "title", body: str = "content",
                    model: str = "scorer") -> DataFrame:
    """Add ``intel``: the checked scorer answer, or the keyword result without one."""
    if scorer is not None:
        answered = evaluate_once(df, _answer=scorer(F.col(title), F.col(body)))
        answered = answered.withColumn("_intel", coerce_assessment(
            loose_object(F.col("_answer")), blank_if_null(F.col(title)), model))
    else:
        answered = df.withColumn("_answer", F.lit(None).cast("string"))
    fallback = let(classify(F.col(title), F.col(body), lex),
                   lambda c: keyword_assessment(F.col(title), c))
    intel = fallback if scorer is None else F.coalesce(F.col("_intel"), fallback)
    drop = [c for c in ("_answer", "_intel") if c in answered.columns]
    return evaluate_once(answered, intel=intel).drop(*drop)


def ai_payload(intel: Column, as_of: Column) -> Column:
    """Stored form of an assessment, with the text caps of the store."""
    return F.struct(
        F.substring(intel["summary"], 1, 500).alias("ai_summary"),
        F.substring(intel["severity_reasoning"], 1, 500).alias("ai_severity_reasoning"),
        F.substring(F.array_join(intel["flags"], ","), 1, 300).alias("ai_flags"),
        intel["model"].alias("ai_model"),
        intel["is_followup"].alias("ai_is_followup"),
        as_of.alias("ai_processed_at"))


__all__ = [
    "CONFIDENCE_MIN", "CONFIDENCE_REVIEW", "Scorer", "ai_payload", "classify",
    "classify_incidents", "classify_incidents_join", "gate_incidents", "gate_incidents_join", "hard_excluded", "keyword_assessment",
    "looks_like_incident", "score_incidents", "severity_of",
]
