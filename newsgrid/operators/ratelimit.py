"""Greedy per-client rate limiting.

A request is let through when at least ``window`` has passed since the last one
that was let through, so a refused request must not move the window and ``lag``
does not work.  The scan is split into time chunks: each chunk is summarised as
a step function (last acceptance before the chunk -> last acceptance after it),
the summaries are folded per client, and every chunk is then marked with its own
carry-in.  Spark partitions and sorts; Python walks sorted Arrow batches and
keeps a few numbers, so neither a busy client nor a long history meets one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_MICROS = 1_000_000
_NEVER = -(2 ** 62)


def _runs(keys: np.ndarray, chunks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of equal (key, chunk) stretches of a sorted batch."""
    if len(keys) == 0:
        return
    edge = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
    starts = np.concatenate(([0], edge))
    yield from zip(starts.tolist(), np.append(edge, len(keys)).tolist())


def _summary(t: np.ndarray, chunk: int, window_us: int, chunk_us: int):
    """Step function of one chunk: (upper end of arrival, last acceptance) pairs."""
    n = len(t)
    if n == 0:  # passes the carry-in on unchanged
        return np.array([_NEVER]), np.array([_NEVER])
    nxt = np.searchsorted(t, t + window_us, "left")
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    # A carry-in lies before the chunk, so it reaches at most one window in.
    reach = int(np.searchsorted(t, chunk * chunk_us + window_us, "left"))
    upto = t[:min(reach, n - 1) + 1]
    leave = t[last[:len(upto)]]
    edge = np.append(leave[1:] != leave[:-1], True)
    return upto[edge], leave[edge]


def _chunk_steps(window_us: int, chunk_us: int):
    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts, out = None, [], []

        def close() -> None:
            if held is not None:
                upto, leave = _summary(np.concatenate(parts), held[1], window_us, chunk_us)
                out.append((held[0], held[1], upto, leave))

        def flush() -> pd.DataFrame:
            sizes = [len(o[2]) for o in out]
            pdf = pd.DataFrame({
                "_key": np.repeat([o[0] for o in out], sizes),
                "_chunk": np.repeat([o[1] for o in out], sizes),
                "_upto": np.concatenate([o[2] for o in out]),
                "_leave": np.concatenate([o[3] for o in out])})
            out.clear()
            return pdf

        for pdf in batches:
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            us, uses = pdf["_us"].to_numpy(), pdf["_uses"].to_numpy()
            for lo, hi in _runs(keys, chunks):
                group = (keys[lo], int(chunks[lo]))
                if group != held:
                    close()
                    held, parts = group, []
                parts.append(np.unique(us[lo:hi][uses[lo:hi]]))
            if out:
                yield flush()
        close()
        if out:
            yield flush()
    return steps


def _carry(window_us: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, carry, enter, done = None, None, _NEVER, _NEVER, False
        for pdf in batches:
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            upto, leave = pdf["_upto"].to_numpy(), pdf["_leave"].to_numpy()
            rows = []
            for lo, hi in _runs(keys, chunks):
                if keys[lo] != key:
                    key, chunk, carry = keys[lo], None, _NEVER
                if chunks[lo] != chunk:
                    chunk, enter, done = chunks[lo], carry, False
                    rows.append((key, int(chunk), enter))
                if done:  # rest of a chunk continued in this batch
                    continue
                at = lo + int(np.searchsorted(upto[lo:hi], enter + window_us, "left"))
                if at < hi:
                    done = True
                    if upto[at] != _NEVER:
                        carry = int(leave[at])
            yield pd.DataFrame(rows, columns=["_key", "_chunk", "_carry"])
    return fold


def _mark(window_us: int):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, _NEVER
        for pdf in batches:
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            us, uses = pdf["_us"].to_numpy(), pdf["_uses"].to_numpy()
            start = pdf["_carry"].to_numpy()
            accepted = np.zeros(len(us), dtype=bool)
            limited = np.zeros(len(us), dtype=bool)
            for lo, hi in _runs(keys, chunks):
                group = (keys[lo], int(chunks[lo]))
                if group != held:
                    held, last = group, int(start[lo])
                at = lo + np.flatnonzero(uses[lo:hi])
                when = us[at]
                first = last
                i = int(np.searchsorted(when, last + window_us, "left"))
                taken = []
                while i < len(at):
                    last = int(when[i])
                    taken.append(at[i])
                    i = int(np.searchsorted(when, last + window_us, "left"))
                accepted[taken] = True
                took = np.where(accepted[lo:hi], us[lo:hi], _NEVER)
                before = np.maximum.accumulate(np.append([first], took[:-1]))
                limited[lo:hi] = us[lo:hi] < before + window_us
            yield pd.DataFrame({"_id": pdf["_id"], "accepted": accepted, "limited": limited})
    return mark


def greedy_accept(events: DataFrame, key: str, ts: str, event_id: str, window_seconds: int,
                  consumes: str | None = None, chunk_seconds: int | None = None) -> DataFrame:
    """``event_id, accepted, limited`` for every event.

    ``consumes`` names a boolean column of requests that may take the window
    (all do by default); the others are only told whether they were limited.
    Equal times are ordered by ``event_id``.  Events without a time can't be placed
    in a window: they are neither accepted nor limited.
    """
    window_us = window_seconds * _MICROS
    chunk_us = (chunk_seconds or max(24 * window_seconds, 86400)) * _MICROS
    id_type = events.schema[event_id].dataType.simpleString()
    uses = F.coalesce(F.col(consumes), F.lit(False)) if consumes else F.lit(True)
    slim = (events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
                          F.col(event_id).alias("_id"), F.unix_micros(ts).alias("_us"),
                          uses.alias("_uses"))
            .withColumn("_chunk", F.expr(f"(_us - pmod(_us, {chunk_us}L)) div {chunk_us}L"))
            # Said once here, or the join adds it to one side and the shuffle runs twice.
            .filter(F.col("_chunk").isNotNull())
            .repartition("_key", "_chunk"))
    order = ["_key", "_chunk", "_us", "_id"]
    steps = slim.sortWithinPartitions(*order).mapInPandas(
        _chunk_steps(window_us, chunk_us), "_key string, _chunk long, _upto long, _leave long")
    carried = (steps.repartition("_key").sortWithinPartitions("_key", "_chunk", "_upto")
               .mapInPandas(_carry(window_us), "_key string, _chunk long, _carry long"))
    marked = (slim.join(carried, ["_key", "_chunk"]).sortWithinPartitions(*order)
              .mapInPandas(_mark(window_us), f"_id {id_type}, accepted boolean, limited boolean"))
    undated = events.filter(F.unix_micros(ts).isNull()).select(
        F.col(event_id).alias("_id"), F.lit(False).alias("accepted"), F.lit(False).alias("limited"))
    return marked.unionByName(undated).withColumnRenamed("_id", event_id)
