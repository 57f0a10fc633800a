"""Cases that failed once: odd input, duplicates, missing values."""

from pyspark.sql import functions as F

from newsgrid.functions import html as hx, text as tx
from newsgrid.operators import dedupe, lexicon as lx, locate, moderation, ratelimit


def test_character_references_never_fail(one):
    given = "a&#xFFFFFF;b&#xD800;c&#0;d&#0000039;e&#99999999999999999999;f&#x1F600;g&#65;"
    assert one(tx.strip_tags(F.col("t")), t=given) == "a�b�c�d'e�f😀gA"


def test_title_of_many_capitalised_words(one):
    title = "Word " * 50_000 + "end"
    assert one(F.size(tx.title_place_candidates(F.col("t"), [])), t=title) == 2
    for t, want in (("New York Cit9", ["New York"]), ("Upper Hill, Lower x", ["Upper Hill, Lower"])):
        assert one(F.slice(tx.title_place_candidates(F.col("t"), []), 1, 1), t=t) == want


def test_selectors_without_a_tag_follow_any_element(one):
    page = "<p>x</p><strong class='level'>High <strong>er</strong></strong> rest <b id='k'>B</b> of page"
    assert one(tx.strip_tags(hx.container_html(F.col("h"), ".level")), h=page) == "High er"
    assert one(tx.strip_tags(hx.container_html(F.col("h"), "#k")), h=page) == "B"


def test_links(one):
    page = "<a href='/p?a=1&amp;b=2'>x</a> <a class=c href=/q>y</a> <a href=\"mailto:a@b\">z</a>"
    assert [r["href"] for r in one(hx.page_links(F.col("h")), h=page)] == ["/p?a=1&b=2", "/q", "mailto:a@b"]
    for href, want in (("mailto:a@b", "mailto:a@b"), ("../x", "https://s.org/x"), ("?q=1", "https://s.org/?q=1"),
                       ("/y/z", "https://s.org/y/z"), ("w", "https://s.org/w"), ("//t.org/", "https://t.org/"),
                       ("https://u.org", "https://u.org"), ("", "")):
        assert one(hx.absolute_url(F.col("a"), F.lit("https://s.org/dir/page")), a=href) == want


def test_reviewers_stay(spark):
    incidents = spark.createDataFrame(
        [(1, "pending", False, True, "ann", "2024-01-01"), (2, "pending", False, True, None, None)],
        "incident_id int, post_status string, is_verified boolean, needs_review boolean, "
        "reviewed_by string, reviewed_at string")
    decisions = spark.createDataFrame([(1, 2, "approve", "bo", "2024-02-02")],
                                      "decision_id int, incident_id int, action string, reviewer string, decided_at string")
    got = {r.incident_id: r for r in moderation.moderate(incidents, decisions).collect()}
    assert (got[1].reviewed_by, got[1].reviewed_at) == ("ann", "2024-01-01")
    assert (got[2].reviewed_by, got[2].post_status) == ("bo", "publish")


def test_two_patches_give_one_incident(spark):
    incidents = spark.createDataFrame([(1, None), (2, "old")], "incident_id int, ai_summary string")
    patches = spark.createDataFrame([(1, "first", "2024-01-01"), (1, "last", "2024-01-02")],
                                    "incident_id int, ai_summary string, ai_processed_at string")
    got = {r.incident_id: r.ai_summary for r in moderation.apply_ai(incidents, patches).collect()}
    assert got == {1: "last", 2: "old"} and moderation.apply_ai(incidents, patches).count() == 2
    edits = spark.createDataFrame([(1, "flood", "2024-01-01"), (1, "fire", "2024-01-02")],
                                  "incident_id int, type string, edited_at string")
    rows = moderation.apply_edits(incidents.withColumn("type", F.lit("x")), edits).collect()
    assert sorted((r.incident_id, r.type) for r in rows) == [(1, "fire"), (2, "x")]


def test_rows_without_url_are_kept(spark):
    batch = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "u", "d"), (5, "u", "e")],
                                  "id int, url string, title string")
    assert dedupe.first_per_url(batch, [F.asc("id")]).count() == 4
    store = spark.createDataFrame([("u", "publish")], "url string, post_status string")
    assert sorted(r.id for r in dedupe.insert_if_absent(batch, store, [F.asc("id")]).collect()) == [1, 2, 3]


def test_undated_requests_have_an_outcome(spark):
    events = spark.sql("SELECT * FROM VALUES (1, 'c', TIMESTAMP '2024-01-01 00:00:00'), (2, 'c', NULL) e(id, k, ts)")
    got = {r.id: (r.accepted, r.limited) for r in ratelimit.greedy_accept(events, "k", "ts", "id", 600).collect()}
    assert got == {1: (True, False), 2: (False, False)}


def test_join_form_finds_phrases_and_marked_words(spark):
    docs = spark.createDataFrame(
        [(1, "The burst dam, a burst dam; outburst dams"), (2, "pile-up at 5 o'clock in the u.s. o'clocks"),
         (3, "-x and x- but dam burst"), (4, "")], "doc_id int, text string")
    table = {"flood": ["burst dam", "dam"], "road": ["pile-up", "-x", "x-"], "time": ["o'clock", "u.s."]}
    lexicon = spark.createDataFrame([(c, t) for c, ts in table.items() for t in ts], "category string, term string")
    joined = {(r.doc_id, r.category): r.hits for r in lx.category_hits_join(docs, "doc_id", "text", lexicon).collect()}
    literal = lx.count_by_category(docs.withColumn("text", F.lower("text")), "text", table).collect()
    assert joined == {(r.doc_id, c): r["n_" + c] for r in literal for c in table if r["n_" + c]}
    assert joined[1, "flood"] == 5 and joined[2, "time"] >= 1


def test_gazetteer_join_finds_long_names(spark):
    names = [("Junction of Old Mill Road", 3), ("Mill", 1), ("Nairobi", 2)]
    rows = [(i, n, 0.0, 0.0, s) for i, (n, s) in enumerate(names)]
    table = spark.createDataFrame(rows, "ord int, name string, lat double, lng double, specificity int")
    docs = spark.createDataFrame([(1, "at the junction of old mill road"), (2, "the mill"), (3, "x")], "doc_id int, text string")
    got = {r.doc_id: r.name for r in locate.gazetteer_match_join(docs, "doc_id", "text", table).collect()}
    literal = docs.select("doc_id", locate.gazetteer_match(F.col("text"), [
        dict(zip(("ord", "name", "lat", "lng", "specificity"), r)) for r in rows]).alias("m")).collect()
    assert got == {r.doc_id: r.m["name"] for r in literal if r.m} == {1: names[0][0], 2: "Mill"}
