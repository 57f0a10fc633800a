"""Sharding by bytes with Karmarkar-Karp differencing (operator 3).

Rows of equal text are one indivisible group.  A group over ``1 / (64 shards)``
of all bytes is an item of its own, of which there are fewer than ``64 shards``;
all others are hashed into a fixed number of bundles.  So the items to balance
are bounded whatever the table holds, and differencing them on the driver
places every row.

Null texts are one group of size 1 a row; empty texts another.  Repeated rows
and null keys are placed and numbered like any other.  An empty table gives an
empty result.  Input columns named as an output are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from newsgrid.llm.common import materialise

BUNDLES = 4096
LARGE_PER_SHARD = 64
SLOT_BUCKETS = 256


def difference(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item: the two partial partitions of largest spread are
    combined, largest part with smallest, until one is left."""
    left: list[list[int]] = []                     # children of a bin; leaves are ~item
    right: list[int] = []

    def joined(a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return b if a is None else a
        left.append(a)
        right.append(b)
        return len(left) - 1

    heap = [(-size, i, [(size, ~i)] + [(0, None)] * (shards - 1))
            for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = sorted(((x + y, joined(p, q)) for (x, p), (y, q) in zip(a, reversed(b))),
                       key=lambda part: -part[0])
        least = parts[-1][0]
        heapq.heappush(heap, (least - parts[0][0], made, [(x - least, p) for x, p in parts]))
        made += 1
    shard = [0] * len(sizes)
    for number, (_, node) in enumerate(heap[0][2] if heap else []):
        open_nodes = [] if node is None else [node]
        while open_nodes:
            node = open_nodes.pop()
            if node < 0:
                shard[~node] = number
            else:
                open_nodes += [left[node], right[node]]
    return shard


def shard_by_bytes(df: DataFrame, shards: int = 16, text: str = "text",
                   keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``size`` (UTF-8 bytes and one), ``text_crc32``, ``shard`` and ``slot``.

    Shards get nearly equal bytes as far as the groups allow; slots of a shard
    count from 0 without a gap.
    """
    spark = df.sparkSession
    outputs = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in keep if c not in outputs]
    column = F.coalesce(df[text], F.lit(""))
    rows = materialise(df.select(
        *keep, (F.octet_length(column) + 1).cast("long").alias("size"),
        F.crc32(column).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(df[text])), F.lit(b"")).alias("_group")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("int")
    large = F.col("bytes") * shards * LARGE_PER_SHARD > total
    items = (rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
             .select("bytes", F.when(large, F.col("_group")).alias("group"),
                     F.when(~large, bundle).alias("bundle"))
             .groupBy("group", "bundle").agg(F.sum("bytes").alias("bytes"))
             .orderBy(F.desc("bytes"), "group", "bundle").collect())
    placed = difference([r.bytes for r in items], shards)
    # Both maps are bounded: 64 * shards and BUNDLES rows.
    whole = spark.createDataFrame([(r.group, s) for r, s in zip(items, placed)
                                   if r.group is not None], "_group binary, _whole int")
    hashed = spark.createDataFrame([(r.bundle, s) for r, s in zip(items, placed)
                                    if r.bundle is not None], "_bundle int, _hashed int")
    sharded = (rows.withColumn("_bundle", bundle)
               .join(F.broadcast(whole), "_group", "left")
               .join(F.broadcast(hashed), "_bundle", "left")
               .withColumn("shard", F.coalesce("_whole", "_hashed"))
               .withColumn("_bucket", F.pmod(F.xxhash64(*keep, "size", "text_crc32"),
                                             F.lit(SLOT_BUCKETS)).cast("int"))
               .drop("_group", "_bundle", "_whole", "_hashed"))
    # Slots: a bucket's first slot from the counts of those before it, of which there
    # are shards * SLOT_BUCKETS, then the order within the bucket.
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = (sharded.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
              .select("shard", "_bucket",
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    within = Window.partitionBy("shard", "_bucket").orderBy(*keep, "size", "text_crc32")
    return (sharded.withColumn("_rank", F.row_number().over(within))
            .join(F.broadcast(firsts), ["shard", "_bucket"])
            .select(*keep, "size", "text_crc32", "shard",
                    (F.col("_first") + F.col("_rank") - 1).alias("slot")))


def write_shards(sharded: DataFrame, path: str, pieces: int = 16) -> None:
    """One folder a shard, in ``pieces`` files of consecutive slots each."""
    (sharded.withColumn("_piece", F.pmod("slot", F.lit(pieces)))
     .repartition("shard", "_piece").sortWithinPartitions("shard", "slot").drop("_piece")
     .write.partitionBy("shard").parquet(path))
