"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from newsgrid.plans.catalog import QUERIES
from newsgrid.session import SCAN_PARTITIONS, build_session

HEADLINE = [
    "c17_source_health", "c16_trend_snapshot", "a15_records_per_type_and_status",
    "w01_keep_first_per_url", "c14_dedupe_and_ingest", "s10_attributes_to_wide_rows",
    "c01_enrich_articles", "c02_sentiment", "c04_topics", "c05_entities", "c06_keywords",
    "c07_classify_incidents", "c08_gate_incidents", "j07_text_lexicon_match",
    "j08_gazetteer_match", "c13_resolve_location", "c09_snap_location", "j10_points_in_county_boxes",
    "c12_backfill_locations", "c18_age_incidents", "c19_expire_incidents", "c20_apply_updates",
    "c26_moderate", "j05_incidents_with_updates", "c22_source_circuit_breaker",
    "w07_zero_yield_streaks", "w09_greedy_rate_limit", "c24_score_incidents", "c25_extract_pages",
    "t24_page_links", "c15_incident_ingest_incidents", "c15_incident_ingest_funnel",
    "c27_ops_dashboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = build_session("newsgrid-bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g", "spark.log.level": "ERROR",
        # The test tables are one row group each, which no reader splits.
        SCAN_PARTITIONS: cpus})
    # JVM and code cache warm-up, not measured.
    QUERIES["c17_source_health"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(sorted(took)[len(took) // 2], 3)
    print(json.dumps({"metric": "newsgrid headline queries, total", "value": round(
        sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(
        sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
