"""NN-descent over all vertices, with what meets packed by parts of the table.

The vertices are put in order and cut into parts of equal size.  A vertex has an
address: its part and its place there.  The graph starts from neighbours within
blocks of vectors that share one of their nearest centres, a sample of the vectors.  Lists of neighbours, messages and vectors
are packed into few rows of arrays, and a round is three steps between parts:

* push: every vertex learns who has it as a neighbour, and its vector goes once to
  each part where it is a neighbour, in either direction;
* meet: the neighbours of each vertex meet, and pairs with a fresh edge that are
  nearer than what either of them has are sent to both;
* merge: the nearest stay, and their ends are told.

What a part holds at once is bounded by the number of its vertices and of their
neighbours, whatever the size of the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrid.llm.common import delete, release, written

LOCAL, CHUNK = 20, 1024            # bits of a place in a part; vertices of a row
LEAST_PARTS, MOST_PARTS, PART = 12, 4000, 36_000
CELLS, BLOCK, MOST_CENTRES = 4, 1024, 4096    # cells of a vector, vectors of a block
PUSHED, MET, TOGETHER, FLUSH = 2048, 1 << 18, 400, 1 << 19    # vectors of a row; distances, vertices and pairs at once
SLACK = 2e-6          # of a squared norm: what a product in single precision may be off
NONE = np.uint32(0xFFFFFFFF)
VEC, GRAPH, REV, GROUP, PUSH, FOUND = range(6)
ROW = "part int, kind int, sender int, edges long, fresh long, a binary, b binary, c binary"
NAMES = ["part", "kind", "sender", "edges", "fresh", "a", "b", "c"]


class Graph(NamedTuple):
    """VEC rows, GRAPH and REV rows; the number of parts, list sizes, and the unit of distances."""

    vectors: DataFrame
    rows: DataFrame
    parts: int
    k: int
    reverse: int
    unit: float


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blobs(x: np.ndarray) -> pa.Array:
    """One binary value for each row of ``x``."""
    x = np.ascontiguousarray(x)
    ends = (np.arange(len(x) + 1) * (x.itemsize * x.shape[1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def unblob(column: pa.Array) -> np.ndarray:
    """The float rows of ``blobs``."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return data.view(np.float32).reshape(len(column), -1)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``x``."""
    norm = (x * x).sum(axis=1)
    return np.maximum(norm[:, None] + norm[None] - 2 * (x @ x.T), 0)


def apart(x: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``s`` and ``t``, from differences: exact where they are close."""
    out = np.empty(len(s), np.float32)
    for a in range(0, len(s), 8192):
        gap = x[s[a:a + 8192]] - x[t[a:a + 8192]]
        out[a:a + 8192] = np.einsum("ij,ij->i", gap, gap)
    return out


def order(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of keys of so many bits."""
    low = max(1, len(keys)).bit_length()
    if bits + low > 64:
        return np.argsort(keys, kind="stable")
    both = (keys.astype(np.uint64) << np.uint64(low)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64)


def pairs(high: np.ndarray, low: np.ndarray, bits: int = 32) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])


def ranks(values: np.ndarray) -> np.ndarray:
    """The place of each of the sorted values among its equals."""
    starts = starts_of(values)
    return np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))


def mixed(u: np.ndarray, v: np.ndarray, bits: int) -> np.ndarray:
    """A hash of two addresses."""
    x = pairs(u, v) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([
        pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in column], kind)
        for column, kind in zip(zip(*rows), kinds)], names=NAMES)


def dealt(kind: int, sender: int, s: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Packed rows for the parts of the addresses ``s``, which are in order."""
    cuts = np.append(starts_of(s >> LOCAL), len(s)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield (int(s[a]) >> LOCAL, kind, sender, 0, 0, s[a:b] & np.uint32((1 << LOCAL) - 1),
               *(v[a:b] for v in values))


def by_kind(rows: Iterator[tuple]) -> dict[int, list[tuple]]:
    """Lists of (sender, a, b, c) by kind."""
    kinds = defaultdict(list)
    for _, kind, *row in rows:
        kinds[kind].append(tuple(row))
    return kinds


def by_part(df: DataFrame, parts: int, step: Callable, schema: str = ROW) -> DataFrame:
    """``step(part, rows)`` for each part; ``rows`` (part, kind, sender, a, b, c) come by kind and sender.

    It gives tuples of packed rows, or record batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                keys = [batch.column(i).to_pylist() for i in range(3)]
                for i, key in enumerate(zip(*keys)):
                    yield (*key, *(batch.column(j)[i].as_buffer() for j in (5, 6, 7)))

        out, size = [], 0
        for part, rows in groupby(read(), key=lambda row: row[0]):
            for row in step(part, rows):
                if isinstance(row, pa.RecordBatch):
                    yield row
                    continue
                out.append(row)
                size += sum(x.nbytes for x in row[5:])
                if size > 1 << 22 or len(out) >= 2000:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    return (df.select(*NAMES).repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part", "kind", "sender").mapInArrow(run, schema))


def joined(rows: list[tuple], i: int, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(r[i], kind) for r in rows)])


def sampled(nodes: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, the middle they are taken from, and the unit of distances."""
    most = nodes.agg(F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).first()[0]
    unit = 2.0 ** int(np.floor(np.log2(most))) if most else 1.0
    wanted = min(MOST_CENTRES, max(1, CELLS * count // BLOCK))
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(max(wanted, 256)).select("vec").collect()
    x = np.array([r.vec for r in rows], np.float64) / unit
    middle = np.median(x, axis=0) if rows else np.float64(0)
    return (x[:wanted] - middle).astype(np.float32), middle, unit


def cells(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centres of each vector, or all of them."""
    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(centres) else np.argsort(d, axis=1)


def along(x: np.ndarray) -> np.ndarray:
    """The place of each vector along a random direction."""
    return (x @ np.random.default_rng(0).normal(size=x.shape[1])).astype(np.float64)


def numbered(nodes: DataFrame, k: int) -> tuple[DataFrame, int, np.ndarray, float]:
    """VEC rows (ids, vectors) and empty GRAPH rows, the number of parts, centres and unit.

    Vectors are taken from a middle and divided by the unit.
    """
    count = nodes.count()
    centres, middle, unit = sampled(nodes, count)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = (matrix(batch.column(1)) / unit - middle).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cells(x, centres, 1)[:, 0], pa.int32()),
                     pa.array(along(x)), blobs(x)], names=["node", "cell", "place", "vec"])

    parts = min(MOST_PARTS, max(min(LEAST_PARTS, -(-count // CHUNK)), -(-count // PART), 1))
    size = max(1, -(-count // parts))
    if size > 1 << LOCAL:
        raise ValueError(f"{count} vectors are over {MOST_PARTS} parts of {1 << LOCAL}")
    placed, path = written(
        nodes.select("node", "vec").mapInArrow(lay, "node long, cell int, place double, vec binary")
        .repartitionByRange(parts, "cell", "place", "node")
        .sortWithinPartitions("cell", "place", "node")
        .select(F.spark_partition_id().alias("run"),
                F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), "node", "vec"),
        "graph-order")
    counts = dict(placed.groupBy("run").count().collect())
    runs = sorted(counts)
    before = dict(zip(runs, np.cumsum([0, *(counts[r] for r in runs)]).tolist()))

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.array([before[r] for r in batch.column(0).to_pylist()]) + batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at // size, pa.int32()), pa.array(at % size), *batch.columns[2:]],
                    names=["part", "place", "node", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
            batch = table.combine_chunks().to_batches()[0]
            part, chunk = int(batch.column(0)[0].as_py()), batch.column(1)[0].as_py() // CHUNK
            n = len(batch)
            yield packed([(part, VEC, chunk, 0, 0, batch.column(2).to_numpy(), unblob(batch.column(3)),
                           np.empty(0)),
                          (part, GRAPH, chunk, 0, 0, np.full((n, k), NONE, np.uint32),
                           np.full((n, k), np.inf, np.float32), np.zeros((n, k), np.uint8))])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            chunk = pairs(table.column(0).to_numpy(), table.column(1).to_numpy() // CHUNK)
            cuts = [*starts_of(chunk).tolist(), len(table)]
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from rows(table.slice(a, b - a))
            held = table.slice(cuts[-2])             # the last chunk may go on
        if held is not None:
            yield from rows(held)

    vectors, _ = written(
        placed.mapInArrow(address, "part int, place long, node long, vec binary")
        .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "place")
        .mapInArrow(pack, ROW), "graph-vectors")
    delete(nodes.sparkSession, path)
    return vectors, parts, centres, unit


def first_found(vectors: DataFrame, parts: int, centres: np.ndarray, k: int) -> DataFrame:
    """FOUND rows of neighbours within blocks of the cells."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, ids, vec in zip(*(batch.column(i) for i in (0, 2, 5, 6))):
                n = len(ids.as_buffer()) // 8
                x = np.frombuffer(vec.as_buffer(), np.float32).reshape(n, -1)
                own = (part.as_py() << LOCAL) + chunk.as_py() * CHUNK + np.arange(n)
                for cell in cells(x, centres, CELLS).T:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(along(x)), pa.array(own), blobs(x)],
                        names=["cell", "place", "own", "vec"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            x, found = unblob(batch.column(2)), []
            ends = [*starts_of(cell).tolist(), len(cell)]
            for start, end in zip(ends, ends[1:]):
                cuts = np.linspace(start, end, 1 + -(-(end - start) // BLOCK)).astype(int).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    if b - a < 2:
                        continue
                    d = squares(x[a:b] - x[a:b].mean(axis=0))
                    np.fill_diagonal(d, np.inf)
                    n = min(k, b - a - 1)
                    near = np.argpartition(d, n - 1, axis=1)[:, :n] + a
                    s = np.repeat(np.arange(a, b), n)
                    found.append((own[s], own[near].ravel(), np.sqrt(apart(x, s, near.ravel()))))
            if found:
                s, t, d = (np.concatenate(c) for c in zip(*found))
                at = order(s, 32)
                yield packed([*dealt(FOUND, 0, s[at], t[at], d[at])])

    placed = vectors.filter(F.col("kind") == VEC).mapInArrow(
        place, "cell int, place double, own long, vec binary")
    return (placed.repartitionByRange(parts, "cell", "place", "own")
            .sortWithinPartitions("cell", "place", "own").select("cell", "own", "vec")
            .mapInArrow(pair, ROW))


def merge(part: int, rows: Iterator[tuple], k: int, reverse: int) -> Iterator[tuple]:
    """The nearest ``k`` of what a vertex has and what was found; their ends are told."""
    rows = by_kind(rows)
    found: list[list] = [[] for _ in range(1 + max(r[0] for r in rows[GRAPH]))]
    for _, a, b, c in rows.get(FOUND, ()):
        s, t, d = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), np.frombuffer(c, np.float32)
        ends = np.searchsorted(s, np.arange(len(found) + 1) * CHUNK)
        for i in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[i], ends[i + 1])
            found[i].append((s[at] - np.uint32(i * CHUNK), t[at], d[at]))
    bits, back = (CHUNK - 1).bit_length() + 32, []
    for chunk, a, b, _ in rows[GRAPH]:
        others, dist = np.frombuffer(a, np.uint32).reshape(-1, k), np.frombuffer(b, np.float32).reshape(-1, k)
        have = others != NONE
        had, n = int(have.sum()), len(others)
        known = (np.nonzero(have)[0].astype(np.uint32), others[have], dist[have])
        s, t, d = (np.concatenate(x) for x in zip(known, *found[chunk]))
        found[chunk] = []
        both = pairs(s, t)
        at = order(both, bits)
        at = at[starts_of(both[at])]             # what was known comes first
        at = at[order(pairs(s[at], d[at].view(np.uint32)), bits)]
        rank = ranks(s[at])
        at, rank = at[rank < k], rank[rank < k]
        s, t, d, new = s[at], t[at], d[at], (at >= had).astype(np.uint8)
        others, dist = np.full((n, k), NONE, np.uint32), np.full((n, k), np.inf, np.float32)
        fresh = np.zeros((n, k), np.uint8)
        others[s, rank], dist[s, rank], fresh[s, rank] = t, d, new
        yield part, GRAPH, chunk, len(at), int(new.sum()), others, dist, fresh
        back.append((t, s + np.uint32((part << LOCAL) + chunk * CHUNK), new))
    v, u, fresh = (np.concatenate(x) for x in zip(*back))
    at = order(pairs(v, mixed(u, v, 10), 10), 42)
    at = at[ranks(v[at]) < reverse]
    yield from dealt(REV, part, v[at], u[at], fresh[at])


def push(part: int, rows: Iterator[tuple], k: int, reverse: int, ids: bool = False) -> Iterator[tuple]:
    """Who meets at each vertex with a fresh edge, and the vectors to the parts where they meet.

    Neighbours meet, and ``reverse`` of those of which a vertex is one: the nearest
    of those are mostly its own neighbours, hence any of them, in order of a hash.
    With ``ids`` groups are of all vertices, and ids go in place of vectors.
    """
    rows = by_kind(rows)
    v, u, fresh = (joined(rows.get(REV, ()), i, kind)
                   for i, kind in ((1, np.uint32), (2, np.uint32), (3, np.uint8)))
    wanted = [np.unique(pairs(u >> LOCAL, v, LOCAL))]
    at = order(pairs(v, mixed(u, v, 20), 20), 20 + LOCAL)
    at = at[ranks(v[at]) < reverse]
    v, u, fresh = v[at], u[at], fresh[at]
    worst = []
    for chunk, a, b, c in rows[GRAPH]:
        others, new = np.frombuffer(a, np.uint32).reshape(-1, k), np.frombuffer(c, np.uint8).reshape(-1, k)
        worst.append(np.frombuffer(b, np.float32).reshape(-1, k)[:, -1])
        mid, slot = np.nonzero(others != NONE)
        other = others[mid, slot]
        wanted.append(np.unique(pairs(other >> LOCAL, (mid + chunk * CHUNK).astype(np.uint64), LOCAL)))
        back = slice(*np.searchsorted(v, [chunk * CHUNK, (chunk + 1) * CHUNK]))
        # Of each pair once, fresh if it is in either direction; fresh ones first.
        both = np.concatenate([pairs(mid, pairs(other, 1 - new[mid, slot], 1), 33),
                               pairs(v[back] - np.uint32(chunk * CHUNK), pairs(u[back], 1 - fresh[back], 1), 33)])
        both.sort()
        both = both[starts_of(both >> np.uint64(1))]
        mid, other, stale = both >> np.uint64(33), both >> np.uint64(1) & np.uint64(NONE), both & np.uint64(1)
        both = pairs(mid, pairs(stale, other), 33)
        both.sort()
        mid = (both >> np.uint64(33)).astype(np.uint16)
        stale, other = (both >> np.uint64(32) & np.uint64(1)).astype(np.uint8), both.astype(np.uint32)
        if not ids:
            starts = starts_of(mid)
            some = np.repeat(stale[starts] == 0, np.diff(np.append(starts, len(mid))))
            mid, other, stale = mid[some], other[some], stale[some]
        if len(mid):
            yield part, GROUP, chunk, 0, 0, mid, other, 1 - stale
    what = joined(rows[VEC], 1, np.int64) if ids else joined(rows[VEC], 2, np.float32).reshape(sum(map(len, worst)), -1)
    worst, wanted = np.concatenate(worst), np.unique(np.concatenate(wanted))
    cuts = [*starts_of(wanted >> np.uint64(LOCAL)).tolist(), len(wanted)]
    for start, end in zip(cuts, cuts[1:]):
        for a in range(start, end, PUSHED):
            local = (wanted[a:min(a + PUSHED, end)] & np.uint64((1 << LOCAL) - 1)).astype(np.uint32)
            yield (int(wanted[start]) >> LOCAL, PUSH, part, 0, 0, local, what[local], worst[local])


def addresses(rows: list[tuple]) -> np.ndarray:
    """Addresses of what was pushed, in order, as the rows are put."""
    rows.sort(key=lambda r: (r[0], np.frombuffer(r[1], np.uint32, 1)[0]))
    return np.concatenate([np.empty(0, np.uint32),
                           *(np.frombuffer(r[1], np.uint32) + np.uint32(r[0] << LOCAL) for r in rows)])


def meet(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs of a vertex's neighbours that are nearer than what one of them has.

    Groups come before the vectors, of which only those of the groups are held.
    """
    groups, where, wide = [], np.empty(0, np.uint32), None
    for _, kind, sender, a, b, c in rows:
        if kind == GROUP:
            # Copies, as a view would hold its whole batch.
            groups.append((np.frombuffer(a, np.uint16).copy(), np.frombuffer(b, np.uint32).copy(),
                           np.frombuffer(c, np.uint8).copy()))
            continue
        if not groups:
            return
        if wide is None:
            where, dim = np.unique(np.concatenate([u for _, u, _ in groups])), len(b) // len(a)
            # Two columns more, so that a product with (-2 x, norm, 1) is a squared distance.
            wide, least = np.empty((len(where), dim + 2), np.float32), np.empty(len(where), np.float32)
        at = np.frombuffer(a, np.uint32) + np.uint32(sender << LOCAL)
        place = np.minimum(np.searchsorted(where, at), len(where) - 1)
        met = where[place] == at
        wide[place[met], :dim] = np.frombuffer(b, np.float32).reshape(-1, dim)[met]
        least[place[met]] = np.frombuffer(c, np.float32)[met] ** 2
    if wide is None:
        return
    vec = wide[:, :dim]
    norm = np.einsum("ij,ij->i", vec, vec)
    wide[:, dim], wide[:, dim + 1] = 1, norm
    about = least + np.float32(SLACK) * norm
    bits, low = len(where).bit_length(), np.float32(-np.inf)
    found: list[list] = [[], []]

    def send() -> Iterator[tuple]:
        s, t = (np.concatenate(x) for x in found)
        for x in found:
            x.clear()
        both = pairs(s, t, bits)
        both.sort()
        both = both[starts_of(both)]
        s, t = (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        d = apart(vec, s, t)
        good = d < least[s]
        yield from dealt(FOUND, part, where[s[good]], where[t[good]], np.sqrt(d[good]))

    for mid, others, fresh in groups:
        near = np.searchsorted(where, others)
        starts = starts_of(mid)
        sizes, news = np.diff(np.append(starts, len(mid))), np.add.reduceat(fresh, starts, dtype=np.int64)
        todo = np.argsort(news, kind="stable")[::-1]
        while len(todo):
            f = int(news[todo[0]])
            some = todo[:max(1, min(TOGETHER, MET // (f * int(sizes.max()))))]
            todo = todo[len(some):]
            n, least_f = int(sizes[some].max()), int(news[some[-1]])
            cols, new = np.arange(n), news[some][:, None]
            there = cols < sizes[some][:, None]
            at = near[np.where(there, starts[some][:, None] + cols, starts[some][:, None])]
            x = wide[at]
            x[..., dim + 1][~there] = np.inf
            y = x[:, :f] * np.float32(-2)
            y[..., dim], y[..., dim + 1] = np.where(cols[:f] < new, norm[at[:, :f]], np.inf), 1
            d = y @ x.transpose(0, 2, 1)
            d[:, cols[:f], cols[:f]] = np.inf
            have = about[at]
            # A fresh one's list gets any, and a known one's list gets the fresh ones.
            hit = np.flatnonzero(d < np.where(cols[:f] < new, have[:, :f], low)[:, :, None])
            row, j = np.divmod(hit, n)
            g, i = np.divmod(row, f)
            found[0].append(at[g, i])
            found[1].append(at[g, j])
            if least_f < n:
                known = np.where((cols >= new) & there, have, low)[:, None, least_f:]
                hit = np.flatnonzero(d[:, :, least_f:] < known)
                row, j = np.divmod(hit, n - least_f)
                g, i = np.divmod(row, f)
                found[0].append(at[g, j + least_f])
                found[1].append(at[g, i])
            if sum(map(len, found[0])) > FLUSH:
                yield from send()
    if found[0]:
        yield from send()


def grown(nodes: DataFrame, k: int, reverse: int, still: float) -> Graph:
    """The graph of ``k`` neighbours, with at most the share ``still`` of fresh edges.

    It has no cap on rounds: a fresh edge makes its vertex's list nearer, so there
    is an end at every size.
    """
    spark = nodes.sparkSession
    vectors, parts, centres, unit = numbered(nodes, k)

    def merged(graph: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
        lists = graph.filter(F.col("kind") == GRAPH)
        return written(by_part(lists.unionByName(found), parts,
                               lambda part, rows: merge(part, rows, k, reverse)), "graph")

    graph, path = merged(vectors, first_found(vectors, parts, centres, k))
    vectors = vectors.filter(F.col("kind") == VEC)
    while True:
        release(spark)
        edges, fresh = graph.agg(F.sum("edges"), F.sum("fresh")).first()
        if (fresh or 0) <= still * (edges or 0):
            return Graph(vectors, graph, parts, k, reverse, unit)
        groups = by_part(vectors.unionByName(graph), parts, lambda part, rows: push(part, rows, k, reverse))
        last = path
        graph, path = merged(graph, by_part(groups, parts, meet))
        delete(spark, last)


def named(graph: Graph, step: Callable, schema: str) -> DataFrame:
    """``step(rows, ids)`` of each part, where ``ids`` gives the ids of addresses in its lists."""
    def run(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = by_kind(rows)
        where = addresses(rows[PUSH])
        known = joined(rows[PUSH], 2, np.int64)
        yield from step(rows, lambda at: known[np.searchsorted(where, at)])

    k, reverse = graph.k, graph.reverse
    own = graph.vectors.unionByName(graph.rows.filter(F.col("kind") == GRAPH))
    groups = by_part(graph.vectors.unionByName(graph.rows), graph.parts,
                     lambda part, rows: push(part, rows, k, reverse, ids=True))
    return by_part(own.unionByName(groups), graph.parts, run, schema)


def edges(graph: Graph) -> DataFrame:
    """``node``, ``other``, ``dist`` and ``fresh`` of each edge."""
    k, unit = graph.k, graph.unit

    def step(rows: dict, ids: Callable) -> Iterator[pa.RecordBatch]:
        nodes = {r[0]: np.frombuffer(r[1], np.int64) for r in rows[VEC]}
        for chunk, a, b, c in rows[GRAPH]:
            others = np.frombuffer(a, np.uint32).reshape(-1, k)
            have = others != NONE
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes[chunk], have.sum(axis=1))), pa.array(ids(others[have])),
                 pa.array(np.frombuffer(b, np.float32).reshape(-1, k)[have] * np.float64(unit)),
                 pa.array(np.frombuffer(c, np.uint8).reshape(-1, k)[have] > 0)],
                names=["node", "other", "dist", "fresh"])

    return named(graph, step, "node long, other long, dist double, fresh boolean")


def links(graph: Graph) -> DataFrame:
    """``node`` and ``others``, the neighbours of each vertex and ``reverse`` of which it is one."""
    def step(rows: dict, ids: Callable) -> Iterator[pa.RecordBatch]:
        nodes = {r[0]: np.frombuffer(r[1], np.int64) for r in rows[VEC]}
        for chunk, a, b, _ in rows[GROUP]:
            mid, others = np.frombuffer(a, np.uint16), ids(np.frombuffer(b, np.uint32))
            starts = starts_of(mid)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(mid)), pa.int32()), pa.array(others))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[chunk][mid[starts]]), lists], names=["node", "others"])

    return named(graph, step, "node long, others array<long>")
