"""Text expressions: term counting, span extraction, tidying, labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from newsgrid.functions.arrays import distinct_ignoring_case, let, strings

# Python-compatible word boundaries: with (?U) a letter outside ASCII is a word
# character on every JDK.  Repeated groups are possessive, which the JVM runs as a
# loop; a backtracking group would recurse once a word and overflow its stack.
_U = "(?U)"
_CAPITALISED = r"[A-Z][a-z]++\b"
# What counts as a span, a place span, a place word and a keyword.
_SPAN = _U + r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b"
_PLACE_SPAN = (_U + r"\b" + _CAPITALISED + r"(?:\s++" + _CAPITALISED + r")++(?:,\s*+"
               + _CAPITALISED + r")*+")
_PLACE_WORD = _U + r"\b[A-Z][a-z]{3,}\b"
_WORD = _U + r"\b[a-z]{4,}\b"
_EDGE = " ,.-"
_NOT_WORD = r"[^\p{L}\p{N}_]++"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_phrase(term: str) -> bool:
    """Terms with a blank or hyphen match as substrings, others as whole words."""
    return " " in term or "-" in term


def alternation(terms: Iterable[str]) -> str:
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


# -- counting ---------------------------------------------------------------

def word_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(_U + r"\b" + re.escape(word) + r"\b"))


def words_of(text: Column) -> Column:
    """All runs of letters, digits and underscores."""
    return F.split(text, _NOT_WORD)


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """Every whole-word occurrence of any listed word, in one pass over the text.

    Whole words cannot overlap, so counting these hits per word equals counting
    each word by itself.  Words with other marks in them are no such runs; they
    are counted by ``odd_word_total``.
    """
    plain = [w for w in words if re.fullmatch(r"\w+", w)]
    if not plain:
        return strings([])
    return F.filter(words_of(text), lambda w: w.isin(*plain))


def odd_word_total(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of the listed words that have marks in them, like ``o'clock``."""
    total = F.lit(0)
    for w in words:
        if not re.fullmatch(r"\w+", w):
            total = total + word_count(text, w)
    return total


def count_among(hits: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(0)
    return F.size(F.filter(hits, lambda h: h.isin(*words)))


def substring_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (gone / F.length(term)).cast("int")


def substring_total(text: Column, terms: Sequence[str]) -> Column:
    """Sum of non-overlapping occurrences over all terms; overlapping terms each count.

    A quoted literal pattern is searched by skipping ahead, several times faster
    than comparing lengths around a replacement.
    """
    total = F.lit(0)
    for term in terms:
        total = total + F.regexp_count(text, F.lit(re.escape(term)))
    return total


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(False)
    return let(text, lambda t: F.exists(strings(terms), lambda term: F.contains(t, term)))


def distinct_contained(text: Column, terms: Sequence[str]) -> Column:
    """How many different terms occur at least once."""
    if not terms:
        return F.lit(0)
    return let(text, lambda t: F.size(F.filter(strings(terms), lambda term: F.contains(t, term))))


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Any of a few regular expressions; each stays a literal, compiled once."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.rlike(text, F.lit(p))
    return found


def blank_out(text: Column, phrases: Sequence[str]) -> Column:
    """Replace listed phrases by a blank, one after the other."""
    if not phrases:
        return text
    return F.aggregate(strings(phrases), text, lambda acc, p: F.replace(acc, p, F.lit(" ")))


# -- spans, tokens ----------------------------------------------------------

def capitalised_spans(text: Column) -> Column:
    """Runs of one to three capitalised words."""
    return F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0))


def lower_tokens(text: Column) -> Column:
    """Words of four or more plain letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def without_words(items: Column, stop: Sequence[str], ignore_case: bool = False) -> Column:
    if not stop:
        return items
    return F.filter(items, lambda x: ~(F.lower(x) if ignore_case else x).isin(*stop))


def ranked_tokens(tokens: Column) -> Column:
    """``array<struct<neg, first, word>>``: most frequent first, ties by first occurrence.

    Row-local and n log n: sort (word, position) pairs, then read the run lengths.
    """
    marks = F.sort_array(F.transform(
        tokens, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def runs_of(m: Column) -> Column:
        last = F.greatest(F.size(m) - 1, F.lit(0))
        heads = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (
            F.get(m, i)["w"] != F.get(m, i - 1)["w"]))
        return let(heads, lambda h: F.transform(h, lambda at, j: F.struct(
            (at - F.coalesce(F.get(h, j + 1), F.size(m))).alias("neg"),
            F.get(m, at)["p"].alias("first"), F.get(m, at)["w"].alias("word"))))

    ranked = F.sort_array(let(marks, runs_of))
    return F.filter(ranked, lambda r: r["word"].isNotNull())


def title_place_candidates(title: Column, stop_words: Sequence[str]) -> Column:
    """Multi-word capitalised spans first, then single capitalised words."""
    multi = F.transform(
        F.regexp_extract_all(title, F.lit(_PLACE_SPAN), F.lit(0)),
        lambda s: F.btrim(s, F.lit(_EDGE)))
    single = without_words(F.regexp_extract_all(title, F.lit(_PLACE_WORD), F.lit(0)), stop_words)
    both = F.concat(multi, single)
    return distinct_ignoring_case(F.filter(both, lambda x: x != ""))


# Words a place hint may open with, longest form first, and the
# markers whose tail is tried on its own.
HINT_OPENERS = ("at the", "at", "in the", "in", "near the", "near", "outside", "inside",
                "around", "from", "on")
HINT_MARKERS = ("junction of ", "intersection of ", "near ", "outside ")


def place_hint_variants(hint: Column) -> Column:
    """A hint, the hint without its opening preposition, and tails after a marker."""
    opener = r"(?i)^(?:" + "|".join(HINT_OPENERS) + r") "

    def variants(raw: Column) -> Column:
        bare = F.when(F.rlike(raw, F.lit(opener)),
                      F.btrim(F.regexp_replace(raw, F.lit(opener), F.lit("")), F.lit(_EDGE))
                      ).otherwise(raw)

        def with_tails(c: Column) -> Column:
            tails = [
                F.when(F.instr(F.lower(c), m) > 0, F.btrim(
                    F.substring(c, F.instr(F.lower(c), m) + F.lit(len(m)), F.length(c)),
                    F.lit(_EDGE)))
                for m in HINT_MARKERS
            ]
            return F.array(raw, c, *tails)

        return let(bare, with_tails)

    trimmed = F.trim(blank_if_null(hint))
    return F.array_distinct(F.filter(let(trimmed, variants), lambda x: x.isNotNull() & (x != "")))


# -- tidying ----------------------------------------------------------------

def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# Named character references decoded in text (ampersand last).
_NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
          ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
          ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"),
          ("&ldquo;", "“"))


def decode_references(c: Column) -> Column:
    """Decode named, decimal and hexadecimal character references.

    A number that is no character gives U+FFFD.
    """
    out = c
    for name, char in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))

    def char(digits: Column, base: int) -> Column:
        # Seven digits hold every code point in either base; more are none.
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        code = F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("int"))
        valid = ((code >= 1) & (code < 0xD800)) | ((code >= 0xE000) & (code <= 0x10FFFF))
        safe = F.when(valid, code).otherwise(0xFFFD)
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def numeric(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d++);"), F.lit(1)))
        return F.aggregate(codes, t, lambda acc, n: F.replace(
            acc, F.concat(F.lit("&#"), n, F.lit(";")), char(n, 10)))

    def hexadecimal(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(
            t, F.lit(r"&#([xX][0-9a-fA-F]++);"), F.lit(1)))
        return F.aggregate(codes, t, lambda acc, n: F.replace(
            acc, F.concat(F.lit("&#"), n, F.lit(";")), char(F.substring(n, 2, 1 << 30), 16)))

    decoded = let(let(out, numeric), hexadecimal)
    return F.replace(decoded, F.lit("&amp;"), F.lit("&"))


def strip_tags(html: Column, sep: str = " ") -> Column:
    """Visible text of a fragment: scripts, styles, comments and tags removed."""
    out = F.regexp_replace(blank_if_null(html), r"(?is)<(script|style)\b.*?</\1\s*>", sep)
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", sep)
    out = F.regexp_replace(out, r"(?s)<[^>]*>", sep)
    return squeeze(decode_references(out))


def slugify(c: Column) -> Column:
    """Lower-case, runs of other characters become one hyphen."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def first_words(c: Column, n: int, more: str = "…") -> Column:
    """The first ``n`` blank-separated words, marked when cut."""
    words = F.split(squeeze(c), " ")
    return let(words, lambda w: F.when(
        F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(more))
    ).otherwise(F.array_join(w, " ")))


def address_hash(address: Column, salt: str) -> Column:
    return F.sha2(F.concat(blank_if_null(address), F.lit(salt)), 256)


# -- labels -----------------------------------------------------------------

def headline_of(c: Column) -> Column:
    """Everything before the last `` - ``; the whole text when there is none."""
    return F.when(F.instr(c, " - ") > 0, F.regexp_extract(c, r"(?s)^(.*) - (.*)$", 1)).otherwise(c)


def publisher_of(c: Column, missing: str = "Unknown") -> Column:
    return F.when(F.instr(c, " - ") > 0, F.substring_index(c, " - ", -1)).otherwise(F.lit(missing))


def search_feed_label(publisher: Column, feed: str = "News search") -> Column:
    return F.concat(F.lit(feed + " ("), publisher, F.lit(")"))


def social_label(platform: Column, handle: Column) -> Column:
    return (F.when(platform.isin("twitter", "x"), F.concat(F.lit("x.com/@"), handle))
            .otherwise(F.concat(platform, F.lit(".com/"), handle)))


def profile_url(platform: Column, handle: Column) -> Column:
    """Public profile address, blank for unknown platforms or handles."""
    enc = F.replace(F.url_encode(handle), F.lit("+"), F.lit("%20"))
    return (
        F.when(blank_if_null(handle) == "", F.lit(""))
        .when(platform.isin("twitter", "x"), F.concat(F.lit("https://twitter.com/"), enc))
        .when((platform == "facebook") & F.rlike(handle, F.lit("^[0-9]+$")),
              F.concat(F.lit("https://www.facebook.com/profile.php?id="), handle))
        .when(platform == "facebook", F.concat(F.lit("https://www.facebook.com/"), enc))
        .when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/channel/"), enc))
        .otherwise(F.lit("")))


def with_level(title: Column, level: Column, max_chars: int | None = None,
               shorter_than: int | None = None) -> Column:
    """Append an advisory level badge: cut to ``max_chars``, or only if short enough."""
    badge = F.trim(blank_if_null(level))
    shown = badge if max_chars is None else F.substring(badge, 1, max_chars)
    use = badge != ""
    if shorter_than is not None:
        use = use & (F.length(badge) < shorter_than)
    return F.when(use, F.concat(title, F.lit(" — "), shown)).otherwise(title)


def place_label(*parts: Column) -> Column:
    """``Subcounty, County, Country`` without the blank ones."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")
