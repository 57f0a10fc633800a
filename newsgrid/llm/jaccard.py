"""Near copies by exact Jaccard similarity of word shingles.

The pipeline's near-copy stage links texts by operator 1 (``simhash.group_near``)
first; what is here adds the similar texts that fingerprints don't tell.

Two texts are linked if the similarity of their sets of ``words``-word shingles is
``similarity`` or more; documents of a group are those reachable over links.
At similarity 0.8 two 64-bit fingerprints differ in 9 to 10 bits, where
fingerprints of unrelated texts can't be told apart cheaply.

Candidates come from prefix filters, which lose no pair.  Under any fixed order
of all shingles, two sets that are similar enough share one among the first
``n - ceil(similarity * n) + 1`` of each.

* First, in order of hashes.  With prefixes longer by ``l`` two similar sets share
  ``l`` shingles of both, so a text whose prefix meets others' in fewer is alone,
  which is most of them (``not_alone``).  Shingles that very many texts have come
  last in that order; how many can be is bounded (``frequent``).
* Of the others all shingles are counted, and the order is by rarity.  A passage
  that many texts have then lies behind whatever else is in them; shingles that
  no other text has fill the prefix and are not indexed at all.

Texts that share an indexed shingle are compared on their sets if size and
position allow the similarity.  Round by round 1, 8, 64, ... texts of every list
are compared with all of the list that links don't connect to them yet, so a
large group of copies takes about one comparison a text.

Words are separated by white space, in lower case as far as A-Z.  Texts without words
are copies of each other; a text with fewer words than a shingle is one shingle.
Contents and shingles are told apart by 64-bit hashes.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.llm.common import delete, lists, materialise, release, written
from newsgrid.llm.components import components
from newsgrid.llm.simhash import SEED

SIMILARITY = 0.8
SALTS = 64               # a text of many pairs is compared in up to so many tasks
CHUNK_IDS = 1 << 21      # shingles that are counted together when frequent ones are looked for
SEEN_OFTEN = 8
COUNTED = 1000           # texts with a shingle are counted up to here
LONG_WORD = 1 << 14      # bytes; longer words go by their digest
SLICE_SHINGLES = 1 << 16
GROWTH = 8
LONGER = 0.1             # of a set, by which prefixes are longer in the first filter

_rng = np.random.default_rng(SEED)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, np.uint64)
FACTOR = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2 ** 64."""
    out = []
    for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        row = np.full(size, factor, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def shingle_ids(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending.

    A shingle's hash is a polynomial in its bytes, taken as a difference of running sums.
    """
    parts = text.lower().split()
    if len(text) > LONG_WORD:
        parts = [w if len(w) <= LONG_WORD else b"\0" + xxhash.xxh3_128_digest(w) for w in parts]
    plain = np.frombuffer(b" ".join(parts), np.uint8)
    gaps = np.flatnonzero(plain == 0x20) if len(text) <= LONG_WORD else np.cumsum(
        np.fromiter(map(len, parts), np.int64, len(parts)) + 1)[:-1] - 1
    if len(gaps) < words:
        starts, ends = np.array([0]), np.array([len(plain)])
    else:
        starts = np.append(0, gaps[:len(gaps) - words + 1] + 1)
        ends = np.append(gaps[words - 1:], len(plain))
    found = []
    for a in range(0, len(starts), SLICE_SHINGLES):
        s, e = starts[a:a + SLICE_SHINGLES], ends[a:a + SLICE_SHINGLES]
        low, high = int(s[0]), int(e[-1])
        power, inverse = _powers(1 << max(16, (high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODES[plain[low:high]] * power[:high - low], out=sums[1:])
        found.append((sums[e - low] - sums[s - low]) * inverse[s - low])
    ids = np.concatenate(found)
    ids ^= ids >> np.uint64(32)
    return np.unique((ids * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))


def prefix_size(n: np.ndarray | int, similarity: float) -> np.ndarray | int:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def content_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _each(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for content, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield content, shingle_ids(text.as_buffer().to_pybytes() if text.is_valid else b"", words)


def frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that very many texts have, ascending.

    Shingles are counted in chunks, and those met SEEN_OFTEN times in a chunk are
    added up.  What comes to SEEN_OFTEN times the number of chunks is frequent: at
    most CHUNK_IDS / SEEN_OFTEN shingles, however large the table.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= SEEN_OFTEN
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *ids[often].tolist()], pa.int64()), pa.array(np.append(1, n[often]), pa.int64())],
                names=["value", "n"])

        held, size = [], 0
        for _, ids in _each(batches, words):
            held.append(ids)
            size += len(ids)
            if size >= CHUNK_IDS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counts = materialise(texts.mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")),
                         "frequent")
    chunks = counts.filter("value IS NULL").first()
    if chunks is None:
        return np.zeros(0, np.int64)
    rows = counts.filter(F.col("value").isNotNull() & (F.col("n") >= SEEN_OFTEN * chunks.n)).collect()
    return np.sort(np.array([r.value for r in rows], np.int64))


def not_alone(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``content`` of texts that may be similar to another, by prefixes in order of hashes.

    A set of n has a prefix longer by ``floor(LONGER * n) + 1`` than one less than the
    usual.  A similar one has ``similarity * n`` shingles at least, so the two prefixes
    share ``floor(LONGER * similarity * n) + 1``, however many others they share.
    """
    last = texts.sparkSession.sparkContext.broadcast(frequent(texts, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, values, need, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            sizes = [len(v) for v in values]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values)), pa.array(np.repeat(np.array(contents, np.int64), sizes)),
                 pa.array(np.repeat(np.array(need, np.int32), sizes))], names=["value", "content", "need"])

        for content, ids in _each(batches, words):
            n = len(ids)
            most = int(prefix_size(n, similarity)) + int(LONGER * n + 1e-9)
            if len(last.value):
                at = np.minimum(np.searchsorted(last.value, ids), len(last.value) - 1)
                often = last.value[at] == ids
                ids = np.concatenate([ids[~often], ids[often]])
            contents.append(content)
            values.append(ids[:most])
            need.append(int(LONGER * similarity * n - 1e-9) + 1 if n else 1)
            size += most
            if size >= 1 << 16:
                yield out()
                contents, values, need, size = [], [], [], 0
        if values:
            yield out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(content: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
            found, first, n = np.unique(content, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(need[first]), pa.array(n)],
                                              names=["content", "need", "n"])

        held = None                               # the row before, and whether it is shared
        for batch in batches:
            value, content, need = (c.to_numpy() for c in batch.columns)
            if not len(value):
                continue
            if held:
                value, content, need = (np.append(x, y) for x, y in zip(held, (value, content, need)))
            hit = np.zeros(len(value), bool)
            same = value[1:] == value[:-1]
            hit[1:] |= same
            hit[:-1] |= same
            if held:
                hit[0] |= held[3]
            held = (value[-1], content[-1], need[-1], hit[-1])
            yield out(content[:-1][hit[:-1]], need[:-1][hit[:-1]])
        if held and held[3]:
            yield out(*(np.array([x]) for x in held[1:3]))

    return (texts.mapInArrow(prefixes, "value long, content long, need int").repartition("value")
            .sortWithinPartitions("value").mapInArrow(shared, "content long, need int, n long")
            .groupBy("content").agg(F.min("need").alias("need"), F.sum("n").alias("n"))
            .filter("n >= need").select("content"))


def shingle_lists(texts: DataFrame, words: int) -> DataFrame:
    """``content``, ``n`` and ``ids``, all shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            sizes = np.array([len(x) for _, x in held], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in held], pa.int64()), pa.array(sizes),
                 lists(np.concatenate([x for _, x in held]), sizes, pa.int64())], names=["content", "n", "ids"])

        held, size = [], 0
        for row in _each(batches, words):
            held.append(row)
            size += len(row[1])
            if size >= 1 << 16:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "content long, n long, ids array<long>")


def rarity_index(sets: DataFrame, similarity: float) -> DataFrame:
    """``value``, ``content``, ``n`` and ``at`` (place in the set, rarest first) of prefixes.

    Shingles of one text only are left out; they take their places in the prefix.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        value, content, n, over = empty, empty, empty, None   # a run that may go on; a value past COUNTED

        def out(end: int) -> pa.RecordBatch:
            first = np.flatnonzero(np.append(True, value[1:end] != value[:end - 1]))
            size = np.diff(np.append(first, end))
            if over is not None and value[0] == over:
                size[0] = COUNTED
                many = np.repeat(size, np.diff(np.append(first, end)))
            else:
                many = np.repeat(size, size)
            keep = many > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(x[:end][keep]) for x in (value, content, n)]
                + [pa.array(np.minimum(many, COUNTED)[keep])], names=["value", "content", "n", "texts"])

        for batch in batches:
            value, content, n = (np.concatenate([x, c.to_numpy()]) for x, c in zip((value, content, n), batch.columns))
            if not len(value):
                continue
            start = int(np.searchsorted(value, value[-1]))
            if start:
                yield out(start)
                value, content, n = value[start:], content[start:], n[start:]
            if len(value) >= COUNTED or over == value[0]:
                over = value[0]
                yield out(len(value))
                value, content, n = empty, empty, empty
        if len(value):
            yield out(len(value))

    rows = (sets.select(F.explode("ids").alias("value"), "content", "n").repartition("value")
            .sortWithinPartitions("value").mapInArrow(counted, "value long, content long, n long, texts long"))
    own = Window.partitionBy("content")
    place = (F.row_number().over(own.orderBy("texts", "value")) - 1
             + F.col("n") - F.count("*").over(own)).alias("at")
    rows = rows.select("value", "content", "n", place)
    return rows.filter(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (``u``, ``v``, ``of``, ``root``) whose contents' sets are similar."""
    names = ["u", "v", "of", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5))):
                few, many = sorted((a.values.to_numpy(), b.values.to_numpy()), key=len)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both = int((many[at] == few).sum())
                keep[i] = both >= similarity * (len(few) + len(many) - both) - 1e-9
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=names).filter(pa.array(keep))

    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = pairs.select("u", "salt").distinct().join(
        sets.select(F.col("content").alias("u"), F.col("ids").alias("a")), "u")
    right = pairs.join(sets.select(F.col("content").alias("v"), F.col("ids").alias("b")), "v")
    return right.join(left.hint("merge"), ["u", "salt"]).select(*names, "a", "b") \
        .mapInArrow(run, "u long, v long, of long, root long")


def unconnected(index: DataFrame, groups: DataFrame, tried: int) -> DataFrame:
    """``index`` with ``root``, of lists that have contents of several groups and some not tried yet."""
    named = index.join(groups, index["content"] == groups["node"]).select("value", "content", "n", "at", "root")
    left = (named.groupBy("value").agg(F.count("*").alias("texts"), F.min("root").alias("low"),
                                       F.max("root").alias("high"))
            .filter((F.col("texts") > tried) & (F.col("low") != F.col("high"))).select("value"))
    return named.join(left, "value", "left_semi")


def candidate_pairs(left: DataFrame, tried: int, now: int, similarity: float) -> DataFrame:
    """``u``, ``v`` and their groups ``of``, ``root``: contents number ``tried`` to ``now`` of every
    list in ``left`` with those of other groups.

    Kept are rows whose places leave room for the overlap that the similarity asks for.
    """
    order = Window.partitionBy("value").orderBy("content")
    pivots = (left.withColumn("number", F.row_number().over(order))
              .filter((F.col("number") <= now)).filter(F.col("number") > tried)
              .select("value", F.col("content").alias("pivot"), F.col("n").alias("m"), F.col("at").alias("place"),
                      F.col("root").alias("of")))
    need = F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9)
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
    size = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    ahead = F.col("pivot") < F.col("content")
    return (left.join(pivots, "value").filter((F.col("root") != F.col("of")) & size & (room >= need))
            .select(F.least("pivot", "content").alias("u"), F.greatest("pivot", "content").alias("v"),
                    F.when(ahead, F.col("of")).otherwise(F.col("root")).alias("of"),
                    F.when(ahead, F.col("root")).otherwise(F.col("of")).alias("root")).distinct())


def linked_already(found: DataFrame) -> DataFrame:
    """``node`` and ``root`` of contents in groups of several, from ``content`` and ``component_id``."""
    moved = found.filter("content <> component_id").select(F.col("content").alias("node"),
                                                           F.col("component_id").alias("root"))
    return moved.unionByName(moved.select(F.col("root").alias("node"), "root").distinct())


def connect(index: DataFrame, sets: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` of every content in ``index`` and ``known``, over all similar pairs.

    ``known`` has the ``node`` and ``root`` of contents that other links connect.
    """
    spark = index.sparkSession
    start = index.select(F.col("content").alias("node"), F.col("content").alias("root")).distinct()
    if known is not None:
        start = start.join(known.hint("merge"), "node", "left_anti").unionByName(known)
    groups, path = written(start, "similar-groups")
    tried, now = 0, 1
    while True:
        left, left_path = written(unconnected(index, groups, tried), "similar-left")
        if left.isEmpty():
            delete(spark, left_path)
            return groups
        pairs, pairs_path = written(candidate_pairs(left, tried, now, similarity), "similar-pairs")
        found, found_path = written(similar(pairs, sets, similarity), "similar")
        roots = components(found.select(F.col("of").alias("u"), F.col("root").alias("v"))) \
            .select(F.col("node").alias("root"), F.col("root").alias("new"))
        last = path
        groups, path = written(groups.join(roots, "root", "left").select(
            "node", F.coalesce("new", "root").alias("root")), "similar-groups")
        for old in (last, left_path, pairs_path, found_path):
            delete(spark, old)
        release(spark)
        tried, now = now, now * GROWTH


def drop_similar(docs: DataFrame, words: int, similarity: float = SIMILARITY, key: str = "doc_id",
                 text: str = "text", linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with the document of least key of each group only.

    ``linked`` takes the different texts (``content``, ``text``) and gives their groups
    (``content``, ``component_id``, the least content) by other links; a group here is
    what both kinds of links connect.
    Rows that share a key stay or go together; rows with a null key stay.
    """
    spark = docs.sparkSession
    content = content_of(docs[text])
    texts, texts_path = written(docs.select(content.alias("content"), docs[text].alias("text")).groupBy("content")
                                .agg(F.any_value("text").alias("text")), "texts")
    release(spark)
    known, known_path = written(linked_already(linked(texts)), "linked") if linked else (None, None)
    release(spark)
    near = materialise(not_alone(texts, words, similarity), "not-alone")
    release(spark)
    sets, sets_path = written(shingle_lists(texts.join(near.hint("merge"), "content", "left_semi"), words), "sets")
    delete(spark, texts_path)
    release(spark)
    index = materialise(rarity_index(sets, similarity), "index")
    release(spark)
    groups = connect(index, sets, similarity, known)
    rows = docs.select(docs[key].alias("key"), content.alias("content"))
    rows = rows.join(groups.hint("merge"), F.col("content") == F.col("node"), "left").select(
        "key", F.coalesce("root", "content").alias("root"))
    rows, rows_path = written(rows, "near-rows")
    least = rows.groupBy("root").agg(F.min("key").alias("least"))
    gone = rows.join(least.hint("merge"), "root").filter("key <> least").select("key").distinct()
    gone = materialise(gone.withColumnRenamed("key", "gone"), "near-copies")
    for old in (rows_path, sets_path, known_path):
        delete(spark, old)
    # The merge join keeps one plan at every size.
    return docs.join(gone.hint("merge"), docs[key] == F.col("gone"), "left_anti").select(docs.columns)
