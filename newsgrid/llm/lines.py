"""Line dedup by winnowing (operator 10).

A text's units are its lines, without blanks at their ends; blank lines are no
units.  A run of consecutive units of one document that has at least ``words``
words in all, and that also occurs earlier (in a document of smaller key, or
higher up in the same one), is deleted.  The earliest occurrence of every run
stays.

The windows of winnowing are the shortest runs with that many words from each
unit on and back from each unit; every run to be deleted is made up of them.
Each window selects its least line hash (the last of equals) as a fingerprint.
Fingerprint positions are joined, those seen once drop out, and matches are
extended both ways to the ends of the windows, whose first occurrence is kept.
Overlapping windows that go form the maximal run.  Counts and first positions
are summed before the shuffle, so a line in a third of all documents sends one
row a task; nothing is compared pairwise.

Null texts stay null, and texts without such a run stay as they are, to the
byte.  Blank lines within a deleted run go with it.  Rows that share a key are
not earlier or later than each other; rows with a null key keep their lines and
delete nothing.  All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsgrid.llm.common import lists, materialise

WORDS = 50


def units(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Line numbers, lines and word counts of the units."""
    numbers, lines, words = [], [], []
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            numbers.append(number)
            lines.append(line.encode())
            words.append(len(line.split()))
    return numbers, lines, words


def windows(words: list[int], most: int) -> list[tuple[int, int]]:
    """Shortest runs of ``most`` words or more, on from and back from every unit; ends excluded."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    on = np.searchsorted(total, total[:-1] + most)          # end of the run from unit i
    back = np.searchsorted(total, total[1:] - most, side="right") - 1
    found = {(i, int(e)) for i, e in enumerate(on) if e <= n}
    found |= {(int(b), i + 1) for i, b in enumerate(back) if b >= 0}
    return sorted(found)


def fingerprints(text: str, most: int) -> list[tuple[int, list[tuple[bytes, int, int]]]]:
    """Selected line hashes, each with the windows that select it: hash, first and end unit."""
    _, lines, words = units(text)
    if sum(words) < most:
        return []
    digests = [blake2b(line, digest_size=16).digest() for line in lines]
    order = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    chosen: dict[int, list[tuple[bytes, int, int]]] = {}
    for a, b in windows(words, most):
        least = min(range(a, b), key=lambda i: (order[i], -i))
        whole = digests[a] if b == a + 1 else blake2b(b"".join(digests[a:b]), digest_size=16).digest()
        chosen.setdefault(least, []).append((whole, a, b))
    return [(order[i], w) for i, w in sorted(chosen.items())]


def repeated_runs(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``key`` and ``spans``: first and end unit of every window that occurs earlier."""
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("print", T.LongType()),
        T.StructField("run", T.BinaryType()), T.StructField("first", T.IntegerType()),
        T.StructField("end", T.IntegerType())])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for value, runs in fingerprints(t or "", words):
                    for whole, a, b in runs:
                        at.append(i)
                        rows.append((value, whole, a, b))
            cut = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cut[0], pa.int64()),
                 pa.array(cut[1], pa.binary()), pa.array(cut[2], pa.int32()),
                 pa.array(cut[3], pa.int32())], names=schema.names)

    selected = materialise(docs.select(docs[key].alias("key"), docs[text].alias("text"))
                           .filter("key IS NOT NULL").mapInArrow(select, schema), "line-windows")
    twice = selected.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    joined = selected.join(twice, "print", "left_semi")
    firsts = (joined.groupBy("run").agg(F.min(F.struct("key", "first")).alias("earliest"),
                                        F.count("*").alias("n"))
              .filter("n > 1").select("run", "earliest"))
    later = (selected.join(firsts, "run")
             .filter(F.struct("key", "first") > F.col("earliest")))
    return later.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end")))
                                    .alias("spans"))


def without_runs(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
    """The text that is left, its number of lines deleted, and the maximal deleted runs of lines."""
    numbers, _, _ = units(text)
    lines = text.split("\n")
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    gone = [(numbers[a], numbers[b - 1] + 1) for a, b in merged]
    kept, at = [], 0
    for a, b in gone:
        kept += lines[at:a]
        at = b
    kept += lines[at:]
    return "\n".join(kept), len(lines) - len(kept), gone


def dedup_lines(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text",
                spans: str | None = None) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``.

    ``spans`` names a column to add: the deleted runs, as first and end line of the old text.
    """
    found = materialise(repeated_runs(docs, words, key, text), "line-runs")
    cut = T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.ArrayType(
        T.StructType([T.StructField("first", T.IntegerType()),
                      T.StructField("end", T.IntegerType())])))])

    @F.pandas_udf(cut)
    def apply(texts, runs):
        import pandas as pd
        out = []
        for t, r in zip(texts, runs):
            if t is None or r is None:
                out.append((t, []))
            else:
                left, _, gone = without_runs(t, [(x["first"], x["end"]) for x in r])
                out.append((left, gone))
        return pd.DataFrame(out, columns=["text", "gone"])

    held = docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("key"))
    old = F.col(f"row.`{text}`")
    # Only texts that change are handed to Python.  The merge join keeps one plan at every size.
    joined = held.join(found.hint("merge"), "key", "left").withColumn(
        "cut", apply(F.when(F.col("spans").isNotNull(), old), F.col("spans")))
    left = F.when(F.col("spans").isNull(), old).otherwise(F.col("cut.text"))
    extra = [] if spans is None else [F.col("cut.gone").alias(spans)]
    return joined.select(*[(left if c == text else F.col(f"row.`{c}`")).alias(c)
                           for c in docs.columns if c != spans], *extra)
