"""Attribute rows to typed wide rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def posts_with_key(posts: DataFrame, postmeta: DataFrame, key: str, name: str | None = None
                   ) -> DataFrame:
    """posts joined with one attribute, posts without it dropped."""
    meta = postmeta.filter(F.col("meta_key") == key).select(
        "post_id", F.col("meta_value").alias(name or key))
    return posts.join(meta, "post_id")


def widen(posts: DataFrame, postmeta: DataFrame, attributes: Mapping[str, tuple[str, object]]
          ) -> DataFrame:
    """``attributes`` maps a key to (type, default); the first stored value of a key wins.

    One partial aggregation per post id, so posts with very many attribute rows
    are reduced before the shuffle.  A blank text value counts as unset.
    """
    firsts = [F.min_by(F.when(F.col("meta_key") == k, F.col("meta_value")),
                       F.when(F.col("meta_key") == k, F.col("meta_id"))).alias(k)
              for k in attributes]
    wide = (postmeta.filter(F.col("meta_key").isin(*attributes))
            .groupBy("post_id").agg(*firsts))
    joined = posts.join(wide, "post_id", "left")
    typed = []
    for name, (kind, default) in attributes.items():
        value = F.when(F.col(name) != "", F.col(name))
        if kind == "timestamp":
            value = F.try_to_timestamp(value)
        elif kind == "boolean":
            value = F.when(value.isNotNull(), F.lower(value).isin("1", "true"))
        elif kind != "string":
            value = value.try_cast(kind)
        typed.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return joined.select(*posts.columns, *typed)
