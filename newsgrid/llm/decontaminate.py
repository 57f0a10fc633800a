"""Test items inside documents by MinHash containment (operator 8), in DataFrame functions only.

Words are runs of letters and digits, in lower case; shingles are ``WORDS`` words
in a row, or all words of an item that has fewer.  An item is found in a document
that has at least ``threshold`` of its distinct shingles.

Items are put into partitions by their number of shingles.  A partition's
MinHash sketch is the least shingle hashes of an item, as many as make sure that
a document with enough of the item's shingles has one of the sketch: one more
than may be missing.  Documents look up all their shingles among the sketches,
so length doesn't dilute a match, and every candidate is verified on the
shingles themselves.

Null and empty texts, and items without a word, match nothing.  Rows whose key
is null are not reported.  Rows that share a key count as one document, which
has what any of them has; items with the same key likewise.  Columns other than
key and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.llm.common import materialise

WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000      # of two longs and an id: a few MB


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _last_start(words: Column, length: int) -> Column:
    return F.size(words) - length


def shingle_texts(words: Column, length: int) -> Column:
    """The distinct shingles of ``length`` words."""
    return F.when(F.size(words) >= length, F.array_distinct(F.transform(
        F.sequence(F.lit(0), _last_start(words, length)),
        lambda i: F.array_join(F.slice(words, i + 1, length), " ")))).otherwise(
            F.array().cast("array<string>"))


def exploded_hashes(df: DataFrame, length: int) -> DataFrame:
    """``key`` and ``h`` for every shingle of column ``words``."""
    placed = (df.filter(F.size("words") >= length)
              .select("key", "words", F.explode(F.sequence(
                  F.lit(0), _last_start(F.col("words"), length))).alias("i")))
    return placed.select("key", F.xxhash64(*[F.get("words", F.col("i") + k)
                                             for k in range(length)]).alias("h"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item``, ``length``, ``n`` shingles, ``least`` hits needed, and ``h`` of the sketch, exploded."""
    hashed = items.select("item", "length", F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("length")),
        lambda i: F.xxhash64(F.slice("words", i + 1, F.col("length")))))).alias("hs"))
    n = F.size("hs")
    missing = n - F.ceil(n * threshold - 1e-9).cast("int")
    # Partition p holds items of 2 ** p to 2 ** (p + 1) - 1 shingles.
    most = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    kept = F.least(n, (F.floor(most * (1 - threshold) + 1e-9) + 1).cast("int"))
    return hashed.select("item", "length", n.alias("n"), (kept - missing).alias("least"),
                         F.explode(F.slice("hs", 1, kept)).alias("h"))


def sized(df: DataFrame) -> DataFrame:
    """Broadcast a written table of few rows; leave the choice to the optimizer beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
               key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """``key``, ``item_key``, ``n_shingles``, ``n_shared`` and ``containment`` of all that are found."""
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter("key IS NOT NULL")
    worded = docs.select("key", words_of(F.col("text")).alias("words"))
    tests = (items.select(items[item_key].alias("item"), words_of(items[item_text]).alias("words"))
             .filter("item IS NOT NULL AND size(words) > 0").dropDuplicates()
             .withColumn("length", F.least(F.lit(WORDS), F.size("words"))))
    sketch = materialise(sketches(tests, threshold), "sketches")
    small = sized(sketch)
    pairs = None
    for length in sorted(r.length for r in sketch.select("length").distinct().collect()):
        hits = (exploded_hashes(worded, length)
                .join(small.filter(F.col("length") == length), "h")
                .groupBy("key", "item", "n", "least", "h").agg(F.lit(1).alias("one"))
                .groupBy("key", "item", "n", "least").agg(F.count("*").alias("hits"))
                .filter("hits >= least").select("key", "item").distinct())
        pairs = hits if pairs is None else pairs.unionByName(hits)
    if pairs is None:
        pairs = docs.select("key", F.lit(None).cast(tests.schema["item"].dataType).alias("item")).limit(0)
    pairs = materialise(pairs, "candidates")
    grouped = sized(materialise(pairs.groupBy("key").agg(F.collect_set("item").alias("found")),
                                "candidate-docs"))
    texts = docs.join(grouped, "key").select(
        "key", words_of(F.col("text")).alias("words"), "found")
    lengths = range(1, WORDS + 1)
    held = texts.select("key", F.explode("found").alias("item"), "words")
    wanted = tests.select("item", "length", F.coalesce(*[
        F.when(F.col("length") == k, shingle_texts(F.col("words"), k)) for k in lengths])
        .alias("wanted"))
    shared = F.coalesce(*[F.when(F.col("length") == k, F.size(F.array_intersect(
        "wanted", shingle_texts(F.col("words"), k)))) for k in lengths])
    return (held.join(sized(materialise(wanted, "items")), "item")
            .select("key", "item", F.size("wanted").cast("long").alias("n_shingles"),
                    shared.cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
            .filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
            .groupBy(F.col("key").alias(key), F.col("item").alias(item_key))
            .agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
            .select(key, item_key, "best.n_shingles", "best.n_shared", "best.containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those in which an item is found."""
    found = materialise(find_items(docs, items, threshold).select("doc_id").distinct(), "contaminated")
    return docs.join(sized(found), "doc_id", "left_anti").select(docs.columns)
