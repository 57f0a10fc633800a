from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import counts, lifecycle, locate, moderation, registry
from newsgrid.operators.ratelimit import greedy_accept
from newsgrid.plans.bindings import countries, county_dicts, counties

NOW = datetime(2024, 3, 31)
INC = ("incident_id long, post_status string, lifecycle string, last_update_at string, "
       "incident_time timestamp, modified_at timestamp")


def ages(spark, rows):
    df = spark.createDataFrame(rows, INC)
    out = lifecycle.age_incidents(df, str(NOW))
    return {r["incident_id"]: (r["lifecycle"], r["resolved_now"], r["archived_now"])
            for r in out.collect()}


def test_ageing_boundaries(spark):
    d = timedelta(days=1)
    rows = [(1, "publish", "active", None, None, NOW - 7 * d),
            (2, "publish", "active", None, None, NOW - 7 * d - timedelta(seconds=1)),
            (3, "publish", None, None, None, NOW - 31 * d),
            (4, "publish", "developing", None, None, NOW - 400 * d),
            (5, "pending", "active", None, None, NOW - 400 * d),
            (6, "publish", "resolved", None, None, NOW - 30 * d),
            (7, "publish", "active", "not a time", NOW, NOW - 400 * d),
            (8, "publish", "active", "2024-03-30T00:00:00Z", NOW - 300 * d, NOW - 400 * d)]
    assert ages(spark, rows) == {
        1: ("active", False, False), 2: ("resolved", True, False), 3: ("archived", True, True),
        4: ("developing", False, False), 5: ("active", False, False),
        6: ("resolved", False, False), 7: ("active", False, False), 8: ("active", False, False)}


def test_ageing_is_monotone(spark):
    order = {"active": 0, "resolved": 1, "archived": 2}
    rows = [(i, "publish", "active", None, None, NOW - timedelta(days=i)) for i in range(60)]
    df = spark.createDataFrame(rows, INC)
    early = {r[0]: r[1] for r in lifecycle.age_incidents(df, str(NOW)).select(
        "incident_id", "lifecycle").collect()}
    late = {r[0]: r[1] for r in lifecycle.age_incidents(df, str(NOW + timedelta(days=9))).select(
        "incident_id", "lifecycle").collect()}
    assert all(order[late[k]] >= order[early[k]] for k in early)


def test_expiry_boundaries(spark):
    h = timedelta(hours=1)
    rows = [(1, "publish", "active", NOW, None), (2, "publish", None, NOW - h, None),
            (3, "publish", "active", NOW + 24 * h, False), (4, "publish", "active", NOW + 25 * h, None),
            (5, "publish", "developing", NOW - h, None), (6, "publish", "active", NOW + h, True),
            (7, "publish", "active", None, None)]
    df = spark.createDataFrame(rows, "incident_id long, post_status string, lifecycle string, "
                                     "expires_at timestamp, expiry_warned boolean")
    out = {r["incident_id"]: (r["expired_now"], r["warned_now"])
           for r in lifecycle.expire_incidents(df, str(NOW)).collect()}
    assert out == {1: (False, True), 2: (True, False), 3: (False, True), 4: (False, False),
                   5: (False, False), 6: (False, False), 7: (False, False)}


def test_updates_count_once_and_unpin(spark):
    i = spark.createDataFrame([(1, "developing", 2, NOW, NOW, True), (2, None, None, None, None, None)],
                              "incident_id long, lifecycle string, update_count int, "
                              "last_update_at timestamp, expires_at timestamp, expiry_warned boolean")
    u = spark.createDataFrame([(10, 1, "publish", NOW), (11, 1, "pending", NOW),
                               (12, 1, "publish", NOW + timedelta(hours=5))],
                              "update_id long, incident_id long, status string, created_at timestamp")
    out = {r["incident_id"]: r for r in lifecycle.apply_updates(i, u).collect()}
    assert (out[1]["update_count"], out[1]["lifecycle"], out[1]["expiry_warned"]) == (4, "active", False)
    assert out[1]["expires_at"] == NOW + timedelta(hours=5, days=7)
    assert out[2]["update_count"] == 0 and out[2]["lifecycle"] is None


def test_validate_updates(spark):
    df = spark.createDataFrame(
        [(1, "<p> </p>", "admin", True), (2, "é" * 2100, "nobody", False), (3, "", None, None)],
        "incident_id long, body string, source string, auto_approve boolean")
    rows = moderation.validate_updates(df, salt="s").collect()
    assert [r["incident_id"] for r in rows] == [2]
    assert rows[0]["body"] == "é" * 2000
    assert (rows[0]["source"], rows[0]["status"]) == ("community", "pending")


def snaps(spark, rows):
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, country string, "
                                     "county string, subcounty string")
    out = locate.snap_location(df, counties(spark), countries(spark)).collect()
    return {r["id"]: None if r["snap"] is None else (
        r["snap"]["precision"], r["snap"]["lat"], r["snap"]["name"], r["snap"]["in_bounds"])
        for r in out}


def test_every_snap_branch(spark):
    assert snaps(spark, [
        (1, 0.0, 32.0, "west-land", "", ""), (2, 9.0, 9.0, "west-land", "", ""),
        (3, 50.0, 60.0, "open-land", "mid-vale", ""), (4, 1.0, 1.0, "nowhere", "", ""),
        (5, 0.0, 37.0, "", "", ""), (6, 50.0, 37.0, "kenya", "", ""),
        (7, 1.0, 39.5, "kenya", "east-hollow", "upper-hollow"),
        (8, 2.5, 39.5, "kenya", "east-hollow", "no-sub"),
        (9, 2.51, 39.5, "kenya", "east-hollow", ""), (10, 3.0, 36.5, "kenya", "mid-vale", ""),
        (11, 0.0, 36.5, "kenya", "no-county", "")]) == {
        1: ("country", 0.0, "West Land", True), 2: ("country", 1.25, "West Land", False),
        3: ("country", 50.0, "Open Land", True), 4: None,
        5: ("country", 0.0, "Kenya", True), 6: ("country", 0.0236, "Kenya", False),
        7: ("subcounty", 1.5, "Upper Hollow, East Hollow", True),
        8: ("exact", 2.5, "East Hollow", True), 9: None,
        10: ("county", -0.5, "Mid Vale", False), 11: None}


def test_no_coordinates_are_left_alone(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, None, None, None, False), (2, 50.0, 10.0, None, None, None, False),
         (3, 50.0, 10.0, "west-land", None, None, False), (4, 0.5, 36.5, None, None, None, False)],
        "incident_id long, latitude double, longitude double, location_country string, "
        "location_precision string, location_county string, needs_review boolean")
    out = {r["incident_id"]: (r["location_precision"], r["needs_review"])
           for r in locate.auto_snap_out_of_bounds(df, county_dicts()).collect()}
    assert out == {1: (None, False), 2: ("county", True), 3: ("country", False), 4: (None, False)}
    back = {r["incident_id"]: r["backfill"] for r in locate.backfill_locations(
        df, county_dicts()).collect()}
    assert back == {1: "skipped", 2: "snapped", 3: "snapped", 4: "labelled"}


def test_edits(spark):
    i = spark.createDataFrame([(1, "flood", "high", "unknown", 1.0)],
                              "incident_id long, type string, severity string, status string, latitude double")
    e = spark.createDataFrame([(1, "alien", "huge", None, 95.0)],
                              "incident_id long, type string, severity string, status string, latitude double")
    assert tuple(moderation.apply_edits(i, e).first())[1:] == ("fire", "low", "unknown", 1.0)
    assert tuple(moderation.apply_edits(i, e, strict=False).first())[1:] == (
        "flood", "high", "unknown", 1.0)


def brute(rows, window):
    last, out = {}, {}
    for ts, client, eid, ok in sorted(rows, key=lambda r: (r[0], r[2])):
        limited = client in last and ts < last[client] + timedelta(seconds=window)
        if ok and not limited:
            last[client] = ts
        out[eid] = (ok and not limited, limited)
    return out


def limited(spark, rows, window, chunk=None):
    df = spark.createDataFrame(rows, "ts timestamp, client string, event_id long, ok boolean")
    return {r["event_id"]: (r["accepted"], r["limited"]) for r in greedy_accept(
        df, "client", "ts", "event_id", window, consumes="ok", chunk_seconds=chunk).collect()}


def test_rate_limit_example(spark):
    rows = [(NOW + timedelta(minutes=m), "a", i, True) for i, m in enumerate((0, 9, 11, 19, 22))]
    got = limited(spark, rows, 600)
    assert [i for i, v in sorted(got.items()) if v[0]] == [0, 2, 4]


@pytest.mark.parametrize("chunk", [60, 97, 300, 1000, 100000])
def test_rate_limit_equals_the_sequential_scan(spark, chunk):
    import random
    rnd = random.Random(chunk)
    rows, t = [], NOW
    for i in range(400):
        t = t + timedelta(seconds=rnd.choice([0, 0, 1, 3, 7, 20, 59, 61, 400]))
        # one client sends most of the requests
        rows.append((t, "hot" if rnd.random() < 0.7 else f"c{rnd.randrange(4)}", i,
                     rnd.random() < 0.8))
    assert limited(spark, rows, 60, chunk) == brute(rows, 60)


def test_streaks_cross_time_buckets(spark):
    import random
    from newsgrid.operators.grouped import zero_streaks
    rnd = random.Random(5)
    rows = [("ab"[rnd.randrange(2)], NOW + timedelta(hours=i), i, rnd.choice([0, 0, 0, 4, 9]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "label string, run_at timestamp, event_id long, articles_seen int")
    want, streak, last = {}, {}, {}
    for label, _, i, n in rows:
        streak[label] = 0 if n else streak.get(label, 0) + 1
        last[label] = n or last.get(label)
        want[i] = (streak[label], last[label])
    for bucket in (3600, 7200, 86400, 10 ** 7):
        got = {r["event_id"]: (r["zero_runs"], r["last_articles"]) for r in zero_streaks(
            df, tie="event_id", bucket_seconds=bucket).collect()}
        assert got == want
    lost = spark.createDataFrame([("a", None, 900, 0), (None, NOW, 901, 3), (None, None, 902, None)], df.schema)
    got = {r["event_id"]: (r["zero_runs"], r["last_articles"]) for r in zero_streaks(
        df.unionByName(lost), tie="event_id").collect()}
    assert got == {**want, **{k: (None, None) for k in (900, 901, 902)}}
    known = registry.circuit_breaker(df, str(NOW + timedelta(days=30)), tie="event_id")
    more = registry.circuit_breaker(df.unionByName(lost), str(NOW + timedelta(days=30)), tie="event_id")
    assert sorted(map(str, more.collect())) == sorted(map(str, known.collect()))


def breaker(spark, seen, as_of):
    rows = [("s", NOW + timedelta(hours=i), n) for i, n in enumerate(seen)]
    df = spark.createDataFrame(rows, "label string, run_at timestamp, articles_seen int")
    r = registry.circuit_breaker(df, str(as_of)).first()
    return r["zero_runs"], r["should_run"]


def test_breaker(spark):
    soon = NOW + timedelta(hours=20)
    assert breaker(spark, [0] * 4, soon) == (4, True)
    assert breaker(spark, [3] + [0] * 5, soon) == (5, False)
    assert breaker(spark, [0] * 5, NOW + timedelta(days=30)) == (0, True)
    assert breaker(spark, [0] * 9, soon) == (4, True)
    assert breaker(spark, [0] * 4 + [1], soon) == (0, True)


def test_source_health_labels(spark):
    rows = [("a", NOW - timedelta(hours=1)), ("b", NOW - timedelta(hours=2)),
            ("c", NOW - timedelta(hours=24)), ("a", NOW - timedelta(days=9))]
    df = spark.createDataFrame(rows, "source string, published_at timestamp")
    got = {r["source"]: (r["status"], r["total"], r["in_window"])
           for r in counts.source_health(df, str(NOW)).collect()}
    assert got == {"a": ("fresh", 2, 1), "b": ("stale", 1, 1), "c": ("down", 1, 1)}


def test_last_decision_holds(spark):
    i = spark.createDataFrame([(1, "pending", None, True)],
                              "incident_id long, post_status string, is_verified boolean, needs_review boolean")
    d = spark.createDataFrame([(1, 1, "approve", "x", NOW), (2, 1, "reject", "x", NOW)],
                              "decision_id long, incident_id long, action string, reviewer string, "
                              "decided_at timestamp")
    assert moderation.moderate(i, d).first()["post_status"] == "trash"
    assert moderation.moderate(i, d.filter("action = 'approve'")).first()["is_verified"] is True


def test_dashboard_on_empty_tables(spark):
    i = spark.createDataFrame([], "incident_id long, post_status string, lifecycle string, "
                                  "needs_review boolean, ai_model string, expires_at timestamp")
    u = spark.createDataFrame([], "status string")
    row = counts.ops_dashboard(i, u, str(NOW)).first()
    assert row["ai_percent"] == 0 and row["pending_updates"] == 0
    assert i.filter(F.lit(True)).count() == 0
