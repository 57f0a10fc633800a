"""Exact substring dedup with suffix arrays (operator 2).

Texts are UTF-8 bytes.  Each byte is removed that some ``length``-byte string
covers which also starts earlier, in a document of smaller key or earlier in the
same one.  Strings are judged on the input and never cross documents.

1. Every ``length``-byte string has an anchor, the ``GRAM``-byte string in it of
   least hash, so equal strings have equal anchors at equal places.  The strings
   with one anchor make up a segment.  Segments are brought together by anchor;
   of equal segments all but the first are removed whole.
2. Different segments with one anchor may still share strings.  Their strings
   are put into classes by the place of the anchor.  Those of a class have a core
   in common, and classes meet by their core.  With the core as one symbol, a
   suffix array over all classes that meet finds equal strings side by side; all
   but the first are removed.

A core in more than ``HOT`` different places is not gathered into one task: its
strings meet by their own bytes instead, first positions being summed before the
shuffle.  Equal segments of one batch of rows are reduced to the first before
the shuffle.

Null and empty texts have no bytes.  Rows that share a key count as one
document and are not earlier or later than each other.  Rows whose key is null
are neither searched nor cut.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from newsgrid.llm.common import materialise, release, slices, text_or_empty
from newsgrid.llm.suffixes import suffix_array

LENGTH = 100
GRAM = 32
CLASS = 12             # strings of a class, by the place of the anchor
HOT = 20_000
SLICE_BYTES = 1 << 20
SYMBOLS = 1 << 17      # of one suffix array, unless a core has more
POSITION_BITS = 31     # of a byte within a slice


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position on; ``gram`` is a power of two."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        size = 1
        while size < gram:
            h = h[:-size] * base + h[size:]
            base, size = base * base, 2 * size
        for _ in range(2):
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def segments(raw: bytes, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Segments of texts laid end to end: first and end string, anchor, and anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))   # the last of equals
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    ends = np.cumsum(sizes)
    inside = np.zeros(len(raw) + 1, np.int32)
    whole = sizes >= length
    inside[(ends - sizes)[whole]] += 1
    np.add.at(inside, (ends - length + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(inside)[:len(least)])
    if not len(at):
        return none, none, none, none
    anchor = (mask - (least[at] & mask)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)))
    first = at[new]
    end = at[np.append(new[1:], len(at)) - 1] + 1
    return first, end, anchor[new], h[anchor[new]].view(np.int64)


def pack(first, end, anchor):
    """A segment as one long that sorts by its first string."""
    return (first << 16) | ((end - first) << 8) | (anchor - first)


def unpack(segment: int) -> tuple[int, int, int]:
    first = segment >> 16
    return first, first + (segment >> 8 & 0xFF), first + (segment & 0xFF)


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).to_numpy(
        zero_copy_only=False).astype(bool)


def emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``anchor``, ``content``, ``key``, ``segment``, ``again``.

    ``again`` marks equals of an earlier row of the batch; their anchors only spread them.
    """
    for batch in batches:
        keys = batch.column(0)
        order = sorted(range(len(keys)), key=keys.to_pylist().__getitem__)
        texts = batch.column(1).take(pa.array(order, pa.int64())).to_pylist()
        keys = keys.take(pa.array(order, pa.int64()))
        number = np.zeros(len(keys), np.int64)
        number[1:] = np.cumsum(changes(keys))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in slices(sizes, SLICE_BYTES):
            raw, n = b"".join(texts[a:b]), sizes[a:b]
            first, end, anchor, h = segments(raw, n)
            if not len(first):
                continue
            digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
            content = np.fromiter(
                (digest(view[x:y]) for x, y in zip(first.tolist(), (end + LENGTH - 1).tolist())),
                np.uint64, len(first)).view(np.int64)
            row = np.searchsorted(np.cumsum(n), first, side="right")
            begin = (np.cumsum(n) - n)[row]
            by = np.lexsort((np.arange(len(first)), content, h))
            again = np.zeros(len(first), bool)
            again[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
            head = np.empty(len(first), np.int64)
            head[by] = by[np.maximum.accumulate(np.where(again[by], 0, np.arange(len(by))))]
            packed = pack(first - begin, end - begin, anchor - begin)
            # Another row with the same key shows the same place once more.
            other = np.flatnonzero(~(again & (number[row + a] == number[row + a][head])
                                     & (packed == packed[head])))
            spread = np.where(again, h + packed * 0x9E3779B97F4A7C1, h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[other]) for x in (spread, content)]
                + [keys.take(pa.array(row[other] + a))]
                + [pa.array(x[other]) for x in (packed, again)],
                names=["anchor", "content", "key", "segment", "again"])


def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key``, ``segment``, ``repeated`` from rows sorted by anchor, content, key, segment.

    Repeated are all but the first of equal segments; the others that are given
    share their anchor with a different segment.  A row equal to the one before is left out.
    """
    last: tuple | None = None                     # anchor, content, key and segment of the row before
    waiting = None                                # the only segment so far of the last anchor
    for batch in batches:
        again = batch.column(4).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~again)
        repeated = np.flatnonzero(again)
        shared = np.zeros(0, np.int64)
        if len(rows):
            anchor, content = batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows]
            same_anchor = np.append(last is not None and anchor[0] == last[0],
                                    anchor[1:] == anchor[:-1])
            same = same_anchor & np.append(last is not None and content[0] == last[1],
                                           content[1:] == content[:-1])
            keys, places = (batch.column(i).take(pa.array(rows)) for i in (2, 3))
            moved = np.append(last is None or (keys[0].as_py(), places[0].as_py()) != last[2:],
                              changes(keys) | changes(places))
            repeated = np.concatenate([repeated, rows[same & moved]])
            heads = np.flatnonzero(~same)
            if len(heads):
                # Whether a different segment with this anchor comes before.
                joined = np.append(same_anchor[heads[0]], anchor[heads[1:]] == anchor[heads[:-1]])
                if waiting is not None and joined[0]:
                    yield waiting
                waiting = None
                mixed = joined.copy()
                mixed[:-1] |= joined[1:]
                shared = rows[heads[mixed]]
                if not mixed[-1]:
                    at = rows[heads[-1]]
                    waiting = pa.RecordBatch.from_arrays(
                        [batch.column(2).slice(at, 1), batch.column(3).slice(at, 1),
                         pa.array([False])], names=["key", "segment", "repeated"])
            last = (int(anchor[-1]), int(content[-1]), keys[-1].as_py(), places[-1].as_py())
        at = np.concatenate([repeated, shared])
        if len(at):
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(index), batch.column(3).take(index),
                 pa.array(np.arange(len(at)) < len(repeated))], names=["key", "segment", "repeated"])


def classes(raw: bytes, segment: int) -> list[tuple[bytes, int, bytes, bytes]]:
    """Core, first string, and the bytes on either side of the core for each class of a segment."""
    first, end, anchor = unpack(segment)
    out = []
    for c in range((anchor - end + 1) // CLASS, (anchor - first) // CLASS + 1):
        a, b = max(anchor - end + 1, c * CLASS), min(anchor - first, c * CLASS + CLASS - 1)
        core = anchor - c * CLASS
        core_end = core - CLASS + 1 + LENGTH
        out.append((xxhash.xxh3_128_digest(raw[core:core_end]), anchor - b,
                    raw[anchor - b:core], raw[core_end:anchor - a + LENGTH]))
    return out


def repeats_by_suffixes(groups: Sequence[Sequence[tuple[int, bytes, bytes]]]) -> list[tuple[int, int]]:
    """(row, string) of all but the first of equal strings.

    A group has (row, left, right) of one core, earliest first; string j of a row
    begins at byte j of its left part.  All groups share one suffix array.
    """
    text: list[int] = []
    rows, firsts = [], []
    for number, group in enumerate(groups):
        for row, left, right in group:
            firsts.append(len(text))
            rows.append(row)
            text += [x + 1 for x in left]
            text.append(257 + number)
            text += [x + 1 for x in right]
            text.append(0)
    ends = [*firsts[1:], len(text)]
    string_of = [-1] * len(text)
    for k, (a, b) in enumerate(zip(firsts, ends)):
        for i in range(a, b - CLASS):
            string_of[i] = k
    out, seen, least = [], None, None
    for i in suffix_array(text):
        if string_of[i] < 0:
            continue
        now = text[i:i + CLASS]
        if now == seen:
            # Rows are laid down earliest first, so the lesser position is the earlier string.
            out.append(max(i, least))
            least = min(i, least)
        else:
            seen, least = now, i
    return [(rows[string_of[i]], i - firsts[string_of[i]]) for i in out]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts (``key``, ``first``, ``end``) from rows ``core``, ``key``, ``at``, ``left``, ``right``,
    sorted by the first three."""
    held: pa.Table | None = None

    def cuts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        core, left, right = (table.column(i).to_pylist() for i in (0, 3, 4))
        starts = [i for i in range(len(core)) if i == 0 or core[i] != core[i - 1]] + [len(core)]
        found: list[tuple[int, int]] = []
        groups, symbols = [], 0
        for a, b in zip(starts, starts[1:]):
            if b - a > 1:
                groups.append([(i, left[i], right[i]) for i in range(a, b)])
                symbols += 2 * CLASS * (b - a)
            if symbols > SYMBOLS:
                found += repeats_by_suffixes(groups)
                groups, symbols = [], 0
        found += repeats_by_suffixes(groups)
        if found:
            rows, strings = np.array(sorted(found)).T
            new = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(strings) != 1)))
            last = np.append(new[1:], len(rows)) - 1
            at = table.column(2).to_numpy()[rows[new]]
            yield pa.RecordBatch.from_arrays(
                [table.column(1).combine_chunks().take(pa.array(rows[new])),
                 pa.array((at + strings[new]).astype(np.int32)),
                 pa.array((at + strings[last] + LENGTH).astype(np.int32))],
                names=["key", "first", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        core = table.column(0)
        cut = len(table) - 1
        while cut and core[cut - 1] == core[len(table) - 1]:
            cut -= 1
        held = table.slice(cut)
        if cut:
            yield from cuts(table.slice(0, cut))
    if held is not None:
        yield from cuts(held)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``cuts``: byte ranges to remove, which may overlap."""
    kind = docs.schema[key].dataType
    texts = docs.select(docs[key].alias("key"), text_or_empty(text).cast("binary").alias("raw")) \
        .filter("key IS NOT NULL")

    def of(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(*f) for f in fields])

    long, integer, binary, flag = T.LongType(), T.IntegerType(), T.BinaryType(), T.BooleanType()
    sorted_out = materialise(
        texts.mapInArrow(emit_segments, of(("anchor", long), ("content", long), ("key", kind),
                                           ("segment", long), ("again", flag)))
        .repartition("anchor").sortWithinPartitions("anchor", "content", "key", "segment")
        .mapInArrow(sort_out, of(("key", kind), ("segment", long), ("repeated", flag))), "segments")
    release(docs.sparkSession)
    whole = sorted_out.filter("repeated").select(
        "key", F.shiftright("segment", 16).cast("int").alias("first"),
        (F.shiftright("segment", 16) + F.shiftright("segment", 8).bitwiseAND(0xFF) + LENGTH - 1)
        .cast("int").alias("end"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (raw, found) in enumerate(zip(batch.column(1).to_pylist(),
                                                 batch.column(2).to_pylist())):
                for segment in found:
                    got = classes(raw, segment)
                    at += [i] * len(got)
                    rows += got
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.binary())], names=["core", "key", "at", "left", "right"])

    mixed = sorted_out.filter("NOT repeated").groupBy("key").agg(F.collect_set("segment").alias("found"))
    cores = materialise(
        texts.join(mixed.hint("merge"), "key").select("key", "raw", "found")
        .mapInArrow(cut_out, of(("core", binary), ("key", kind), ("at", integer),
                                ("left", binary), ("right", binary))), "cores")
    release(docs.sparkSession)
    met = cores.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1")
    hot = materialise(met.filter(F.col("n") > HOT).select("core"), "hot-cores")
    cut_type = of(("key", kind), ("first", integer), ("end", integer))
    partly = (cores.join(hot, "core", "left_anti").repartition("core")
              .sortWithinPartitions("core", "key", "at").mapInArrow(compare, cut_type))
    # Strings of hot cores, one row each, by the core and the bytes around it.
    strings = cores.join(hot, "core").select(
        "core", "key", F.posexplode(F.sequence(F.col("at"), F.col("at") + F.length("left")
                                               + F.length("right") - CLASS + 1)).alias("j", "first"),
        "left", "right").select(
            "core", "key", "first", F.expr("substr(left, j + 1)").alias("head"),
            F.expr(f"substr(right, 1, {CLASS - 1} - greatest(length(left) - j, 0))").alias("tail"))
    earliest = strings.groupBy("core", "head", "tail").agg(
        F.min(F.struct("key", "first")).alias("earliest"))
    hot_cuts = (strings.join(earliest, ["core", "head", "tail"])
                .filter(F.struct("key", "first") > F.col("earliest"))
                .select("key", "first", (F.col("first") + LENGTH).alias("end")))
    cuts = whole.unionByName(partly).unionByName(hot_cuts)
    return cuts.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("cuts"))


def without(raw: bytes, cuts: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that are left, and the maximal ranges removed."""
    merged: list[list[int]] = []
    for cut in cuts:
        if merged and cut["first"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], cut["end"])
        else:
            merged.append([cut["first"], cut["end"]])
    kept, at = [], 0
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), [(a, b) for a, b in merged]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``kept`` (the bytes that are left) and ``spans`` (the maximal ranges removed)."""
    found = materialise(repeated_bytes(docs, key, text), "cuts")
    release(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()),
                                     T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[key], T.StructField("kept", T.BinaryType()),
                           T.StructField("spans", span)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for raw, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, gone = without(raw, cuts or [])
                kept.append(left)
                spans.append([{"first": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                names=schema.names)

    texts = docs.select(docs[key].alias("key"), text_or_empty(text).cast("binary").alias("raw"))
    return texts.join(found.hint("merge"), "key", "left").select("key", "raw", "cuts").mapInArrow(
        apply, schema)
