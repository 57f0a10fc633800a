"""SimHash near-dedup by the general pigeonhole principle (operator 1).

Fingerprints have 64 bits, each set where over half of a text's word-shingle
hashes have it set.  Two fingerprints are linked at ``radius`` or fewer
differing bits; documents of a group are those reachable over links.

Bits are grouped into partitions so that correlated ones share one.  If the
partitions' thresholds add up to ``radius - partitions + 1``, every linked pair
is within the threshold of some partition.  The thresholds are unequal: dynamic
programming gives those, and the number of partitions, with the least cost by
estimated candidate counts.  The estimates use the means and products of all
bits over all distinct fingerprints.  Every fingerprint probes the values within
the threshold, and pairs are verified while they are joined.

Copies are one fingerprint.  Each value has a pivot, the fingerprint of most
documents.  Those within ``radius`` of it link to it and not to each other, so a
tight group of any size gives one link each; all others are compared in full.

A text that is null or has no words has fingerprint zero; a text with fewer
words than a shingle is one shingle.  Rows that repeat get the same group; a
group's id is null only if all its keys are.  An empty table gives an empty
result.  Input columns named as an output are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from newsgrid.llm.common import materialise
from newsgrid.llm.components import components

BITS = 64
SEED = 42
WORDS = 4
RADIUS = 4
PROBE_COST, PAIR_COST = 1.0, 0.05      # a shuffled probe against a compared pair


def fingerprint(text: str, words: int = WORDS) -> int:
    """Words are between ASCII white space, A-Z in lower case."""
    plain = b" ".join(text.encode().lower().split())
    if not plain:
        return 0
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    n, digest = len(gaps) + 1, xxhash.xxh64_intdigest
    if n <= words:
        hashes = [digest(plain, SEED)]
    else:
        starts = [0, *(gaps[:n - words] + 1).tolist()]
        ends = [*gaps[words - 1:].tolist(), len(plain)]
        hashes = [digest(plain[a:b], SEED) for a, b in zip(starts, ends)]
    raw = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words: int = WORDS, text: str = "text",
                 keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``print``, the fingerprint as a signed long."""
    carried = df.select(*keep).schema
    schema = T.StructType([*carried, T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.fromiter((fingerprint(t.as_py() or "", words) for t in texts), np.uint64,
                                 batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))], names=schema.names)

    return df.select(*keep, df[text].alias("_text_to_hash")).mapInArrow(run, schema)


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["at", "n"])

    rows = (prints.select("print").mapInArrow(run, "at long, n long")
            .groupBy("at").agg(F.sum("n").alias("n")).collect())      # BITS * BITS + 1 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(correlation: np.ndarray, count: int) -> list[list[int]]:
    """``count`` partitions of nearly equal width; each takes the bits most correlated with it."""
    strength = np.abs(correlation)
    np.fill_diagonal(strength, 0)
    free, out = list(range(BITS)), []
    for k in range(count):
        width = BITS // count + (k < BITS % count)
        bits = [max(free, key=lambda b: strength[b, free].sum())]
        free.remove(bits[0])
        while len(bits) < width:
            best = max(free, key=lambda b: strength[b, bits].sum())
            bits.append(best)
            free.remove(best)
        out.append(bits)
    return out


def near_probability(bits: list[int], agree: np.ndarray) -> np.ndarray:
    """For each t, the estimated chance that two fingerprints differ in t or fewer of ``bits``.

    Bits differ as if independent, scaled by how much more often than that
    neighbours in the partition agree together.
    """
    chance = np.array([1.0])
    for b in bits:
        chance = np.convolve(chance, [agree[b, b], 1 - agree[b, b]])
    lift = np.prod([agree[a, b] / max(agree[a, a] * agree[b, b], 1e-12)
                    for a, b in zip(bits[::2], bits[1::2])])
    return np.minimum(np.cumsum(chance) * lift, 1.0)


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) that add up to ``budget`` at the least cost.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best[budget]


def plan_probes(n: int, both: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A bit mask and a threshold for every partition that is probed."""
    n_or_1 = max(n, 1)
    p = np.diag(both) / n_or_1
    joint = both / n_or_1
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = (joint - np.outer(p, p)) / np.outer(spread, spread)
    # Two fingerprints agree in bits i and j with the squares of the four joint chances.
    one_i, one_j = p[:, None] - joint, p[None, :] - joint
    agree = joint ** 2 + one_i ** 2 + one_j ** 2 + (1 - joint - one_i - one_j) ** 2
    np.fill_diagonal(agree, p ** 2 + (1 - p) ** 2)
    plans = []
    for count in range(2, radius + 2):
        groups = group_bits(correlation, count)
        costs = []
        for bits in groups:
            near = near_probability(bits, agree)
            costs.append([0.0] + [
                PROBE_COST * n * sum(comb(len(bits), k) for k in range(t + 1))
                + PAIR_COST * n * n / 2 * near[t] for t in range(min(radius, len(bits) - 1) + 1)])
        cost, thresholds = allocate(costs, radius - count + 1)
        plans.append((cost, [(sum(1 << b for b in bits), t)
                             for bits, t in zip(groups, thresholds) if t >= 0]))
    return min(plans)[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u``, ``v``: enough of the pairs within ``radius`` to connect all of them.

    ``prints`` has distinct ``print`` and the number ``n`` of documents of each.
    """
    plan = plan_probes(*bit_moments(prints), radius)
    values = F.array(*[F.struct(F.lit(i).alias("part"),
                                F.col("print").bitwiseAND(F.lit(_signed(mask))).alias("value"))
                       for i, (mask, _) in enumerate(plan)])
    index = prints.select("print", "n", F.inline(values))
    pivots = index.groupBy("part", "value").agg(
        F.max(F.struct("n", "print")).getField("print").alias("pivot"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("pivot"))) <= radius
    index = index.join(pivots, ["part", "value"]).select(
        "part", "value", F.col("print").alias("v"), "pivot", near.alias("near"))
    flips = F.array(*[
        F.struct(F.lit(i).alias("part"),
                 F.col("print").bitwiseAND(F.lit(_signed(mask)))
                 .bitwiseXOR(F.lit(_signed(sum(1 << b for b in chosen)))).alias("value"))
        for i, (mask, threshold) in enumerate(plan) for k in range(threshold + 1)
        for chosen in combinations([b for b in range(BITS) if mask >> b & 1], k)])
    probes = prints.select(F.col("print").alias("u"), F.inline(flips))

    def within(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius

    p, i = probes.alias("p"), index.alias("i")
    return p.join(i, (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value"))
                  & (F.col("u") != F.col("v")) & within("u", "v")
                  & ((F.col("v") == F.col("pivot")) | ~(F.col("near") & within("u", "pivot")))
                  ).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def group_near(df: DataFrame, words: int = WORDS, radius: int = RADIUS, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (hexadecimal) and ``component_id``, the least key of the group."""
    rows = materialise(fingerprints(df, words, text, (key,)), "fingerprints")
    prints = materialise(rows.groupBy("print").agg(F.count("*").alias("n"), F.min(key).alias("least")),
                         "distinct-prints")
    groups = components(links(prints, radius))
    linked = groups.join(prints, F.col("node") == F.col("print")).select("print", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select(F.col("print").alias("node"), "component")
    named = prints.join(linked, F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("component", "least").alias("component_id"))
    return rows.join(named, "print").select(
        key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
