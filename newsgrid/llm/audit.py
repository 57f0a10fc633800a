"""How filters interact: every order of application, by part (operator 11).

A document's mask says which filters it fails.  For n filters there are n!
orders of n steps, and a mask settles the outcome of each step: removed here,
failing here but removed earlier, or kept.  Every mask (with its labels) maps to
one wide integer of 64-bit fields, one field for each outcome of each step.  A
part's documents are counted by mask, the integers are added up, and the sum is
cut into its fields.  A field counts documents, fewer than 2 ** 63, so none runs
over into the next.

Only rows of (part, mask, count), at most 128 a part for five filters, reach
Python; a part with a third of all documents costs what any other costs.

Null texts are empty texts and null sources the part ''.  Rows with a null key
are neither copies nor originals of another and have no labels.  Repeated rows
count each; rows that share a key and a text are not copies of each other.  A
document is labelled if any of its label rows says so.  An empty table has no
parts.  Of the documents only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.llm.common import materialise, text_or_empty

WIDTH = 8                              # bytes of a field
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"

OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
       "unique_fails long, good_lost long, toxic_lost long, shapley long")


class Ledger:
    """The integers of all masks of ``names`` (one letter a filter), and what their sums say."""

    def __init__(self, names: str):
        self.names, n = names, len(names)
        self.orders = np.array(list(permutations(range(n))), np.int64)
        self.cells = self.orders.size
        self.fields = 4 * self.cells + n + 1

    def integer(self, fails: int, good: bool, toxic: bool) -> int:
        """One document's outcomes: removed, redundant, good lost, toxic lost a cell; alone a filter; itself."""
        failing = (fails >> self.orders & 1).astype(bool)
        earlier = (np.cumsum(failing, axis=1) - failing) > 0
        removed = (failing & ~earlier).ravel()
        alone = [fails == 1 << k for k in range(len(self.names))]
        fields = np.concatenate([removed, (failing & earlier).ravel(), removed & good, removed & toxic,
                                 alone, [True]]).astype("<u8")
        return int.from_bytes(fields.tobytes(), "little")

    def unpack(self, total: int) -> dict[str, np.ndarray]:
        """A sum of integers as columns, one row a cell."""
        fields = np.frombuffer(total.to_bytes(self.fields * WIDTH, "little"), "<u8").astype(np.int64)
        removed, redundant, good, toxic = fields[:4 * self.cells].reshape(4, self.cells)
        alone, count = fields[4 * self.cells:-1], fields[-1]
        steps = removed.reshape(self.orders.shape)
        letters = self.orders.ravel()
        shapley = np.array([removed[letters == k].sum() for k in range(len(self.names))], np.int64)
        return {"kept": (count - np.cumsum(steps, axis=1)).ravel(), "removed": removed, "redundant": redundant,
                "unique_fails": alone[letters], "good_lost": good, "toxic_lost": toxic,
                "shapley": shapley[letters]}


def report(counts: DataFrame, names: str) -> DataFrame:
    """One row a part, order and step from ``counts`` (part, fails, good, toxic, n; one row a class)."""
    ledger = Ledger(names)
    orders = ["".join(names[k] for k in o) for o in ledger.orders.tolist()]
    per_order = len(names)

    def rows(part: str, total: int) -> pa.RecordBatch:
        columns = ledger.unpack(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * ledger.cells, pa.string()),
             pa.array([o for o in orders for _ in range(per_order)], pa.string()),
             pa.array(list(range(1, per_order + 1)) * len(orders), pa.int32()),
             *(pa.array(v, pa.int64()) for v in columns.values())],
            names=["part", "filter_order", "step", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        integers: dict[tuple, int] = {}
        part, total = None, 0
        for batch in batches:
            for name, *mask, n in zip(*(c.to_pylist() for c in batch.columns)):
                if name != part:
                    if total:
                        yield rows(part, total)
                    part, total = name, 0
                if tuple(mask) not in integers:
                    integers[tuple(mask)] = ledger.integer(*mask)
                total += n * integers[tuple(mask)]
        if total:
            yield rows(part, total)

    return (counts.select("part", "fails", "good", "toxic", "n").repartition("part")
            .sortWithinPartitions("part").mapInArrow(run, OUT))


def text_checks(text: Column) -> list[Column]:
    """Failure of A to D: too few words, too few different ones, many capitals, marks of markup."""
    trimmed = F.btrim(text, F.lit(WHITE))
    # Inside the lambda the words are one value, cut once.
    counts = F.transform(F.array(F.split(trimmed, r"[\x20\x09-\x0D]+")), lambda w: F.struct(
        F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("different")))[0]
    none = trimmed == ""
    words = F.when(none, 0).otherwise(counts["words"])
    different = F.when(none, 0).otherwise(counts["different"])
    # By bytes, as what goes is one byte each.
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
    return [words < 200, 100 * different < 50 * words,
            100 * capitals.cast("long") > 2 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def classes(docs: DataFrame, labels: DataFrame, checks: Sequence[Column], key: str = "doc_id",
            text: str = "text", part: str = "source") -> DataFrame:
    """Documents counted by ``part``, ``fails`` (bit k: filter k), ``good`` and ``toxic``.

    The last filter, after ``checks``, fails for texts that a smaller key has.
    Originals are found by digest, and met again by digest and key, so that copies
    of one text are not brought together.
    """
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(checks)), F.lit(0))
    rows = materialise(docs.select(
        docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("digest"), mask.alias("fails")),
        "audit-rows")
    known = rows.filter("key IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("key").alias("first"))
    known = known.join(firsts.withColumnRenamed("digest", "of"),
                       (F.col("digest") == F.col("of")) & (F.col("key") == F.col("first")), "left")
    marked = labels.filter(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(
        F.col(key).alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                          F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = known.join(marked, F.col("key") == F.col("labelled"), "left").select(
        "part", (F.col("fails") + F.when(F.col("first").isNull(), 1 << len(checks)).otherwise(0)).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    unknown = rows.filter("key IS NULL").select("part", "fails", F.lit(False).alias("good"),
                                                F.lit(False).alias("toxic"))
    return known.unionByName(unknown).groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """The report over filters A to D (``text_checks``) and E (copies)."""
    docs = docs.select(docs[key], docs[part], text_or_empty(text).alias(text))
    return report(classes(docs, labels, text_checks(docs[text]), key, text, part), "ABCDE")
