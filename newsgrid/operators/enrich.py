"""Article enrichment: sentiment, lean, topics, entities, keywords.

All of it is row-local: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.arrays import head, let
from newsgrid.functions.numbers import clamp, round_half_even
from newsgrid.functions.text import (
    blank_if_null, capitalised_spans, count_among, odd_word_total, lower_tokens, ranked_tokens, substring_total,
    without_words, word_hits,
)
from newsgrid.operators.lexicon import ArticleLexicon, Categories

POSITIVE_AT, NEGATIVE_AT = 0.15, -0.15


def article_text(title: Column, content: Column, excerpt: Column | None = None) -> Column:
    """Title and body as one text; the excerpt stands in for a missing body."""
    body = blank_if_null(content)
    if excerpt is not None:
        body = F.when(body != "", body).otherwise(blank_if_null(excerpt))
    return F.trim(F.concat(blank_if_null(title), F.lit("\n"), body))


def sentiment_score(text: Column, valence: Mapping[str, float],
                    max_chars: int | None = None) -> Column:
    """Summed word valence squashed to [-1, 1] by ``s / sqrt(s*s + 15)``."""
    shown = F.lower(text if max_chars is None else F.substring(text, 1, max_chars))
    levels: dict[float, list[str]] = {}
    for word, value in valence.items():
        levels.setdefault(float(value), []).append(word)

    def total(t: Column, hits: Column) -> Column:
        out = F.lit(0.0)
        for value, words in levels.items():
            out = out + (count_among(hits, words) + odd_word_total(t, words)) * F.lit(value)
        return out

    both = let(shown, lambda t: F.struct(t.alias("t"), word_hits(t, list(valence)).alias("h")))
    return let(let(both, lambda x: total(x["t"], x["h"])),
               lambda s: s / F.sqrt(s * s + F.lit(15.0)))


def sentiment_label(score: Column) -> Column:
    return (F.when(score >= POSITIVE_AT, F.lit("positive"))
            .when(score <= NEGATIVE_AT, F.lit("negative")).otherwise(F.lit("neutral")))


def bias_score(text: Column, baseline: Column, left: Sequence[str], right: Sequence[str]) -> Column:
    """Source baseline plus three points per net term, drift within ±25, total within ±100."""
    drift = let(F.lower(text), lambda t: clamp(
        (substring_total(t, right) - substring_total(t, left)) * 3, -25, 25))
    return clamp(F.coalesce(baseline, F.lit(0)) + drift, -100, 100)


def topics(text: Column, lexicon: Categories, k: int = 4) -> Column:
    """The ``k`` topics with the most term occurrences, table order on ties."""
    if not lexicon:
        return F.array().cast("array<string>")

    def ranked(low: Column) -> Column:
        counts = F.array(*[F.struct((-substring_total(low, terms)).alias("neg"),
                                    F.lit(i).alias("ord"), F.lit(name).alias("name"))
                           for i, (name, terms) in enumerate(lexicon.items())])
        return F.sort_array(F.filter(counts, lambda c: c["neg"] < 0))

    return F.transform(head(let(F.lower(text), ranked), k), lambda c: c["name"])


def entities(text: Column, stop: Sequence[str], scan: int = 20, keep: int = 10) -> Column:
    """Distinct capitalised spans in order, all filed under persons."""
    spans = F.array_distinct(without_words(capitalised_spans(text), stop, ignore_case=True))
    none = F.array().cast("array<string>")
    return F.struct(head(head(spans, scan), keep).alias("persons"),
                    none.alias("orgs"), none.alias("places"))


def keywords(text: Column, stop: Sequence[str], k: int = 5, pool: int = 30) -> Column:
    """Most frequent words: the ``pool`` most common first, stop words out, then ``k``."""
    ranked = head(ranked_tokens(lower_tokens(text)), pool)
    return head(without_words(F.transform(ranked, lambda r: r["word"]), stop), k)


def enrich_articles(df: DataFrame, lexicon: ArticleLexicon, title: str = "title",
                    content: str = "content", excerpt: str | None = "excerpt",
                    baseline: str = "bias_baseline", max_chars: int | None = None,
                    sentiment: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add sentiment, sentiment_score, bias_score, topics, keywords and entities.

    ``sentiment`` may replace the valence table by any text -> score expression,
    for example a ``pandas_udf``.

    Blank articles keep their baseline and get neutral defaults, which is what
    the expressions give on an empty text.
    """
    text = article_text(F.col(title), F.col(content),
                        F.col(excerpt) if excerpt and excerpt in df.columns else None)
    base = F.col(baseline) if baseline in df.columns else F.lit(0)
    t = F.col("_text")
    # Plain columns, so that those nobody reads are pruned away.
    return (df.withColumn("_text", text).withColumn("_base", base)
            .withColumns({
                "sentiment_score": round_half_even(
                    sentiment(t) if sentiment is not None
                    else sentiment_score(t, lexicon.valence, max_chars), 3),
                "bias_score": bias_score(t, F.col("_base"), lexicon.left, lexicon.right)
                .cast("int"),
                "topics": topics(t, lexicon.topics),
                "keywords": keywords(t, lexicon.stop),
                "entities": entities(t, lexicon.stop)})
            .withColumn("sentiment", sentiment_label(F.col("sentiment_score")))
            .drop("_text", "_base"))
