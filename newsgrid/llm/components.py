"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgrid.llm.common import delete, written


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """At most as many rows as ``links``; some may be repeated."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least id reachable) of every node in links (``u``, ``v``).

    Large-star and small-star steps alternate until nothing moves, which takes a
    number of rounds that grows with the logarithm of the longest path.  A node's
    least neighbour is found before the shuffle; no neighbourhood is collected.
    """
    spark = links.sparkSession
    links, path = written(links.filter("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        last = path
        links, path = written(_small_star(_large_star(links)), "links")
        delete(spark, last)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))
                             .distinct())
