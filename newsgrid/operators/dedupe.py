"""Seen-set and insert-if-absent joins.

Batches are reduced to one row per URL before any join, so a URL that fills a
third of the batch cannot skew the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.functions.text import blank_if_null
from newsgrid.operators.grouped import keep_first
from newsgrid.schemas import LIVE_STATUSES


def _first(batch: DataFrame, order: Sequence[Column], url: str) -> DataFrame:
    """One row per URL; rows without one are told apart by all their values."""
    own = F.when(blank_if_null(F.col(url)) == "", F.xxhash64(*batch.columns))
    return keep_first(batch.withColumn("_own", own), [url, "_own"], order).drop("_own")


def first_per_url(batch: DataFrame, order: Sequence[Column], url: str = "url") -> DataFrame:
    """The first row of every URL, and every different row without one."""
    return _first(batch, order, url)


def drop_seen(batch: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return batch.join(seen.select(url).distinct(), url, "left_anti")


def mark_seen(seen: DataFrame, written: DataFrame, as_of, url: str = "url") -> DataFrame:
    """New seen rows: URLs that were written and are not in the set yet."""
    from newsgrid.functions.dates import instant
    new = written.select(url).distinct().join(seen.select(url), url, "left_anti")
    return new.withColumn("created_at", instant(as_of))


def existing_ids(batch: DataFrame, store: DataFrame, store_id: str, url: str = "url",
                 store_url: str = "url", status: str = "post_status") -> DataFrame:
    """The batch with ``existing_id``: the id already stored for its URL, else null.

    Trashed rows do not count, and a blank URL never matches.
    """
    live = (store.filter(F.col(status).isin(*LIVE_STATUSES)) if status in store.columns else store)
    known = (live.filter(blank_if_null(F.col(store_url)) != "")
             .groupBy(F.col(store_url).alias(url)).agg(F.min(store_id).alias("existing_id")))
    return batch.join(known, url, "left")


def insert_if_absent(batch: DataFrame, store: DataFrame, order: Sequence[Column],
                     url: str = "url", store_url: str = "url",
                     status: str = "post_status") -> DataFrame:
    """Rows of the batch to insert: titled, first of their URL, not stored live yet.

    Rows without a URL cannot be compared with the store; all different ones are inserted.
    """
    titled = batch.filter(F.trim(blank_if_null(F.col("title"))) != "") if "title" in batch.columns \
        else batch
    live = store.filter(F.col(status).isin(*LIVE_STATUSES)) if status in store.columns else store
    first = _first(titled, order, url)
    stored = live.select(F.col(store_url).alias(url)).filter(blank_if_null(F.col(url)) != "")
    return first.join(stored.distinct(), url, "left_anti").select(*batch.columns)


def required(batch: DataFrame, *fields: str) -> DataFrame:
    """Rows that have all of the fields; blank is as good as missing."""
    return batch.filter(" AND ".join(f"trim(coalesce({f}, '')) <> ''" for f in fields))


def rejects(batch: DataFrame, required: str = "title") -> DataFrame:
    """Rows refused for a missing required field, with the reason."""
    return (batch.filter(F.trim(blank_if_null(F.col(required))) == "")
            .withColumn("reject_reason", F.lit("missing " + required)))
