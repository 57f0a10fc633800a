from pyspark.sql import functions as F

from newsgrid.functions import dates, html, numbers, records, text as tx
from newsgrid.functions.arrays import distinct_ignoring_case, join_list, split_list


def c(name="t"):
    return F.col(name)


def test_word_count_respects_accents(one):
    assert one(tx.word_count(c(), "caf"), t="café caf caf-caf") == 3
    assert one(F.size(tx.word_hits(c(), ["caf", "expos"])), t="café exposé caf") == 1


def test_substring_count_does_not_overlap(one):
    assert one(tx.substring_count(c(), F.lit("aa")), t="aaaa a") == 2
    assert one(tx.substring_total(c(), ["aa", "a a"]), t="aaaa a") == 3


def test_terms_with_special_characters_are_literal(one):
    assert one(tx.substring_total(c(), ["a.c", "(x)"]), t="abc a.c (x)") == 2
    assert one(tx.contains_any(c(), ["a.c"]), t="abc") is False


def test_blank_out_in_order(one):
    assert one(tx.blank_out(c(), ["on fire", "fire"]), t="team on fire, fire") == "team  ,  "


def test_ranked_tokens_counts_and_ties(one):
    rows = one(tx.ranked_tokens(tx.lower_tokens(c())), t="beta alpha beta gamma alpha delta beta")
    assert [(r["word"], -r["neg"]) for r in rows] == [
        ("beta", 3), ("alpha", 2), ("gamma", 1), ("delta", 1)]
    assert one(tx.ranked_tokens(tx.lower_tokens(c())), t="a b") == []


def test_title_place_candidates(one):
    got = one(tx.title_place_candidates(c(), ["Police", "The"]),
              t="Police in Fort Worth, Texas find Worth and Murang'a")
    assert got == ["Fort Worth, Texas", "Fort", "Worth", "Texas", "Murang"]


def test_place_hint_variants(one):
    v = one(tx.place_hint_variants(c()), t=" At the junction of Oak and Elm road. ")
    assert v == ["At the junction of Oak and Elm road.", "junction of Oak and Elm road",
                 "Oak and Elm road"]
    assert one(tx.place_hint_variants(c()), t="  ") == []


def test_headline_and_publisher(one):
    t = "A - B - The Daily"
    assert one(tx.headline_of(c()), t=t) == "A - B"
    assert one(tx.publisher_of(c()), t=t) == "The Daily"
    assert one(tx.publisher_of(c()), t="plain") == "Unknown"


def test_tag_stripping_and_references(one):
    t = "<p>a&amp;lt;b &#233;&#xE9;</p><script>var x='</p>'</script><!-- no --><b>c</b>"
    assert one(tx.strip_tags(c()), t=t) == "a&lt;b éé c"


def test_first_words(one):
    assert one(tx.first_words(c(), 2), t=" a  b c") == "a b…"
    assert one(tx.first_words(c(), 3), t="a b c") == "a b c"


def test_level_badges(one):
    assert one(tx.with_level(F.lit("T"), c(), 5), t="Level 2: careful") == "T — Level"
    assert one(tx.with_level(F.lit("T"), c(), shorter_than=5), t="Level 2") == "T"


def test_profile_urls(one):
    assert one(tx.profile_url(F.lit("facebook"), c()), t="123").endswith("profile.php?id=123")
    assert one(tx.profile_url(F.lit("x"), c()), t="a b") == "https://twitter.com/a%20b"
    assert one(tx.profile_url(F.lit("radio"), c()), t="a") == ""


def test_list_text_round_trip(one):
    assert one(split_list(c()), t=" a, ,b,") == ["a", "b"]
    assert one(join_list(split_list(c())), t=" a, ,b,") == "a,b"
    assert one(distinct_ignoring_case(F.split(c(), " ")), t="A b a B c") == ["A", "b", "c"]


def test_dates(one):
    iso = "2025-03-03T00:00:00"
    assert one(dates.reissue_date(c()), t="x Reissued with updates to crime: March 3, 2025 y"
               ).isoformat() == iso
    assert one(dates.reissue_date(c()), t="Updated Marchtember 3, 2025") is None
    assert one(dates.last_updated_date(c()), t="Last updated: 05.02.2025").isoformat()[:10] == \
        "2025-02-05"
    assert one(dates.parse_instant(c(), "2024-01-01 00:00:00"), t="nonsense").year == 2024
    assert one(dates.parse_instant(c(), "2024-01-01 00:00:00"),
               t="Mon, 03 Mar 2025 10:00:00 GMT").hour == 10


def test_japanese_level_pattern(one):
    assert one(F.regexp_extract(c(), r"(レベル\s*[1-4])", 1), t="危険 レベル 2 です") == "レベル 2"


def test_age_is_never_negative(one):
    ts = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert one(dates.age_seconds(ts, "2024-01-01 00:00:00")) == 0


def test_percent_and_rounding(one):
    assert one(numbers.percent(F.lit(1), F.lit(0))) == 0
    assert one(numbers.percent(F.lit(1), F.lit(8))) == 13
    assert one(numbers.round_half_even(F.lit(0.125), 2)) == 0.12


PAGE = """<html><head><meta content="Shared &amp; told" property="og:title"><title>Own</title>
<meta name="description" content="About it"></head><body>
<div class="x story-body"><div>one</div><div>two<div>three</div></div></div><div>four</div>
<time datetime="2024-05-06T07:08:09Z">x</time></body></html>"""


def test_page_fields(one):
    assert one(html.page_title(c()), t=PAGE) == "Shared & told"
    assert one(html.page_title(c(), F.lit("Given")), t=PAGE) == "Given"
    assert one(html.page_excerpt(c()), t=PAGE) == "About it"
    assert one(html.page_body(c()), t=PAGE) == "one two three"
    assert one(html.page_body(c(), ["#none", "div.nope"]), t=PAGE) == ""
    assert one(html.page_published(c(), "2020-01-01 00:00:00"), t=PAGE).year == 2024


def test_json_ld_date_wins(one):
    t = '<script type="application/ld+json">[{"datePublished":"2023-01-02"}]</script>' + PAGE
    assert one(html.page_published(c(), "2020-01-01 00:00:00"), t=t).year == 2023


def test_absolute_urls(one):
    base = F.lit("https://a.example/x/y?q=1")
    assert one(html.absolute_url(c(), base), t="/z") == "https://a.example/z"
    assert one(html.absolute_url(c(), base), t="z") == "https://a.example/z"
    assert one(html.absolute_url(c(), base), t="//cdn/z") == "https://cdn/z"
    assert one(html.absolute_url(c(), base), t="http://b/") == "http://b/"


def _coerced(one, reply):
    return one(records.coerce_assessment(records.loose_object(c()), F.lit("Title"), "m"), t=reply)


def test_coercion(one):
    got = _coerced(one, '```json\n{"is_incident": "false", "incident_type": " FIRE ", '
                   '"severity": "awful", "confidence": "0.7x", "flags": "Rumor", "summary": ""}\n```')
    assert (got["is_incident"], got["incident_type"], got["severity"]) == (False, "fire", "low")
    assert (got["confidence"], got["flags"], got["summary"]) == (0.0, ["rumor"], "Title")
    got = _coerced(one, 'Sure: {"is_incident": true, "incident_type": "alien", "confidence": 7, '
                   '"flags": ["a"," ","b","c","d","e","f","g","h","i"]} bye')
    assert (got["is_incident"], got["incident_type"], got["confidence"]) == (True, "info", 1.0)
    assert got["flags"] == list("abcdefgh")
    assert _coerced(one, "{broken") is None
    assert _coerced(one, "no json here") is None


def test_entities_tolerate_bad_json(one):
    assert one(records.parse_entities(c()), t="{oops")["persons"] == []
    assert one(records.parse_entities(c()), t='{"places": ["x"]}')["places"] == ["x"]


def test_joined_parts_skip_empty_bodies(spark):
    df = spark.sql("""SELECT array(named_struct('title', 'A', 'body', '<p>x</p>'),
        named_struct('title', 'B', 'body', '<p> </p>'), named_struct('title', 'C', 'body', 'y')) AS p""")
    assert df.select(records.joined_parts(F.col("p"))).first()[0] == "## A\nx\n\n## C\ny"


def test_advisory_rules(spark):
    from newsgrid.sources.pages import AdvisoryRule, advisory_pages
    pages = spark.createDataFrame([
        ("a", "<h1>Conseils</h1><div class='my-Level-x'>Level 2: care</div><article>Text. Reissued "
              "with updates: March 3, 2025 now</article>"),
        ("b", "<main>危険 レベル 2<time datetime='2024-02-03T00:00:00Z'></time></main>"),
        ("c", "<article>plain</article>")], "issuer string, html string")
    rules = [AdvisoryRule("a", "A", title_from="h1", title_prefix="Office: ",
                          level=("[class*='level']",), level_max=7, dated="reissued"),
             AdvisoryRule("b", "B", level_pattern=r"(レベル\s*[1-4])", excerpt="Info.", dated="time"),
             AdvisoryRule("c", "C", title_from="h1", excerpt_from_body=True)]
    out = {r["issuer"]: r for r in advisory_pages(pages, rules, "2020-01-01 00:00:00").collect()}
    assert out["a"]["title"] == "Office: Conseils — Level 2"
    assert out["a"]["published_at"].month == 3
    assert (out["b"]["title"], out["b"]["excerpt"]) == ("B — レベル 2", "Info. レベル 2")
    assert out["b"]["published_at"].year == 2024
    assert (out["c"]["title"], out["c"]["excerpt"]) == ("C", "plain")
