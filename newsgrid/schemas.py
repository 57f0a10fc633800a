"""Column layouts of the landed and stored records."""

from __future__ import annotations

RAW_ARTICLE = (
    "url string, title string, excerpt string, content string, published_at string, "
    "source string, source_id string, tier int, bias_baseline int, "
    "social_handle string, platform string"
)

ENTITIES = "struct<persons:array<string>,orgs:array<string>,places:array<string>>"

ARTICLE = (
    "article_id long, url string, title string, excerpt string, content string, source string, "
    "source_id string, tier int, bias_baseline int, published_at timestamp, ingested_at timestamp, "
    "sentiment string, sentiment_score double, bias_score int, topics array<string>, "
    f"keywords array<string>, entities {ENTITIES}"
)

INCIDENT = (
    "incident_id long, title string, type string, severity string, status string, "
    "latitude double, longitude double, video_url string, location_name string, "
    "location_country string, location_county string, location_subcounty string, "
    "location_precision string, incident_time timestamp, source_url string, reporter_name string, "
    "is_anonymous boolean, is_verified boolean, corroboration_count int, post_status string, "
    "needs_review boolean, review_reason string, confidence double, ai_summary string, "
    "ai_severity_reasoning string, ai_flags array<string>, ai_model string, ai_is_followup boolean, "
    "ai_processed_at timestamp, lifecycle string, last_update_at timestamp, update_count int, "
    "expires_at timestamp, expiry_warned boolean, created_at timestamp, modified_at timestamp"
)

UPDATE = (
    "update_id long, incident_id long, status string, title string, body string, source string, "
    "reporter string, severity_hint string, ip_hash string, created_at timestamp"
)

SOCIAL_POST = (
    "post_id long, title string, content string, platform string, author_handle string, "
    "post_url string, engagement long, created_at timestamp"
)

SEEN = "url string, created_at timestamp"
RUN = "label string, run_at timestamp, articles_seen int"
LEXICON = "kind string, category string, ord int, term string, weight double"
GAZETTEER = "ord int, name string, lat double, lng double, specificity int"
COUNTY = (
    "ord int, name string, slug string, lat double, lng double, min_lat double, min_lng double, "
    "max_lat double, max_lng double, subs array<struct<name:string,slug:string,lat:double,lng:double>>"
)
COUNTRY = (
    "ord int, name string, slug string, lat double, lng double, "
    "min_lat double, min_lng double, max_lat double, max_lng double"
)
SOURCE_REGISTRY = (
    "id string, name string, source_domain string, tier int, bias_baseline int, "
    "rss array<string>, scrape_pages array<string>, link_selectors array<string>, "
    "link_pattern string, content_selectors array<string>, cadence string, enabled boolean, "
    "timeout int, verify_ssl boolean"
)
SOCIAL_REGISTRY = (
    "id string, name string, platform string, handle string, tier int, bias_baseline int, "
    "max_per_run int, cadence string, enabled boolean"
)

# The enumerations stored records are checked against.
INCIDENT_TYPES = (
    "fire", "accident", "flood", "protest", "police", "weather", "medical",
    "military", "info", "health", "environmental", "homicide", "femicide",
)
SEVERITIES = ("low", "medium", "high")
SAFETY_STATUSES = ("unsafe", "all_clear", "police_operating", "police_aggressive", "unknown")
LIFECYCLES = ("active", "developing", "resolved", "archived")
PRECISIONS = ("exact", "subcounty", "county", "country")
UPDATE_SOURCES = ("community", "witness", "scraper", "admin")
LIVE_STATUSES = ("publish", "pending", "draft")
REVIEW_FLAGS = ("unverified", "speculative", "rumor", "single_source")
WINDOWS = {"1h": 3600, "24h": 86400, "7d": 7 * 86400, "30d": 30 * 86400}
