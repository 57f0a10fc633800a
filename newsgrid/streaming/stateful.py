"""Keyed state: rate limits, incident ageing, source breakers.

Every key keeps a few numbers.  Rows of one key in one micro-batch are read in
time order; the batch itself is bounded by the source's per-trigger limit.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_DAY_MS = 86_400_000


class _GreedyLimit(StatefulProcessor):
    def __init__(self, window_us: int, keep_ms: int | None) -> None:
        self.window_us, self.keep_ms = window_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        moved = False
        rows = list(rows)
        for r in rows:
            if r.us is None:                      # can't be placed in a window
                yield Row(client=key[0], event_id=r.event_id, accepted=False, limited=False)
        dated = [r for r in rows if r.us is not None]
        for r in sorted(dated, key=lambda r: (r.us, r.event_id)):
            limited = last is not None and r.us < last + self.window_us
            accepted = r.uses and not limited
            if accepted:
                last, moved = r.us, True
            yield Row(client=key[0], event_id=r.event_id, accepted=accepted, limited=limited)
        if moved:
            self.last.update((last,))

    def close(self) -> None:
        pass


def limit_rate(stream: DataFrame, key: str, ts: str, event_id: str, window_seconds: int,
               consumes: str | None = None, expire_state: bool = False) -> DataFrame:
    """Streaming form of ``operators.ratelimit.greedy_accept``.

    ``expire_state`` drops idle clients a day after their window.  It needs
    processing-time mode, which never lets an ``availableNow`` run come to an end,
    so it is for continuously running queries only.
    """
    uses = F.coalesce(F.col(consumes), F.lit(False)) if consumes else F.lit(True)
    slim = stream.select(F.col(key).cast("string").alias("client"),
                         F.col(event_id).cast("long").alias("event_id"),
                         F.unix_micros(ts).alias("us"), uses.alias("uses"))
    return slim.groupBy("client").transformWithState(
        _GreedyLimit(window_seconds * 1_000_000,
                     window_seconds * 1000 + _DAY_MS if expire_state else None),
        "client string, event_id long, accepted boolean, limited boolean", "append",
        "ProcessingTime" if expire_state else "None")


class _Ageing(StatefulProcessor):
    """Timers per incident: warn, expire, resolve, archive; a new update restarts them."""

    def __init__(self, expiry_ms: int, warn_ms: int, resolve_ms: int, archive_ms: int) -> None:
        self.after = {"warned": expiry_ms - warn_ms, "expired": expiry_ms,
                      "resolved": resolve_ms, "archived": archive_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(r.ms for r in rows)
        before = self.at.get()[0] if self.at.exists() else None
        if before is not None and newest <= before:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, Row)) else timer)
        self.at.update((newest,))
        for due in sorted({newest + d for d in self.after.values()}):
            self.handle.registerTimer(due)
        yield Row(incident_id=key[0], stage="active", at_ms=newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        at = self.at.get()[0]
        for stage, delay in self.after.items():
            if at + delay == due:
                yield Row(incident_id=key[0], stage=stage, at_ms=due)
        if due >= at + max(self.after.values()):
            self.at.clear()

    def close(self) -> None:
        pass


def age_stream(updates: DataFrame, incident_id: str = "incident_id", ts: str = "ts",
               late: str = "1 hour", expiry_days: int = 7, warn_hours: int = 24,
               resolve_days: int = 7, archive_days: int = 30) -> DataFrame:
    """``incident_id, stage, at_ms`` transitions from a stream of activity.

    Expiry and resolving share their default delay; both are reported.
    """
    slim = (updates.withWatermark(ts, late)
            .select(F.col(incident_id).cast("long").alias("incident_id"), F.col(ts).alias("ts"),
                    F.unix_millis(ts).alias("ms")).filter("ms IS NOT NULL"))
    return slim.groupBy("incident_id").transformWithState(
        _Ageing(expiry_days * _DAY_MS, warn_hours * 3_600_000, resolve_days * _DAY_MS,
                archive_days * _DAY_MS),
        "incident_id long, stage string, at_ms long", "append", "EventTime")


HELD_ROWS = 1 << 16
NO_TIE = -1 << 63


def _ending(ms: np.ndarray, tie: np.ndarray, seen: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of the rows from each label's last row with something seen on, in time order."""
    order = np.lexsort((seen, tie, ms, label))
    sorted_label = label[order]
    starts = np.flatnonzero(np.append(True, sorted_label[1:] != sorted_label[:-1]))
    at = np.arange(len(order))
    last = np.maximum.reduceat(np.where(seen[order] > 0, at, -1), starts)
    return order[at >= np.repeat(last, np.diff(np.append(starts, len(order))))]


def ending_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label``, ``ms``, ``tie``, ``seen`` without rows that a later one of the label overrides.

    A row with something seen ends all that was before it.  A task holds about
    HELD_ROWS rows at a time.
    """
    def cut(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        label = rows.column(0).dictionary_encode("encode").indices.to_numpy()
        return rows.take(pa.array(_ending(*(rows.column(i).to_numpy() for i in (1, 2, 3)), label)))

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= HELD_ROWS:
            rest = cut(held)
            held, size = [rest], rest.num_rows
            if 2 * size >= HELD_ROWS:
                yield rest
                held, size = [], 0
    if held:
        yield cut(held)


class _Breaker(StatefulProcessor):
    """A row with something seen sets a streak to zero; the others behind it are only counted.

    Of a batch the last such row and the times of what may be behind it are held, 16 bytes a row.
    """

    def __init__(self, threshold: int, pause_ms: int) -> None:
        self.threshold, self.pause_ms = threshold, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "streak long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        streak, last = self.state.get() if self.state.exists() else (0, None)
        top, zeros, room = None, (array("q"), array("q")), HELD_ROWS

        def behind() -> tuple[np.ndarray, np.ndarray]:
            ms, tie = (np.frombuffer(x, np.int64) for x in zeros)
            keep = slice(None) if top is None else (ms > top[0]) | ((ms == top[0]) & (tie > top[1]))
            return ms[keep], tie[keep]

        for r in rows:
            if r.seen > 0:
                top = max(top, (r.ms, r.tie, r.seen)) if top else (r.ms, r.tie, r.seen)
            elif top is None or (r.ms, r.tie) > top[:2]:
                zeros[0].append(r.ms)
                zeros[1].append(r.tie)
                if len(zeros[0]) >= room:
                    zeros = tuple(array("q", x.tobytes()) for x in behind())
                    room = max(HELD_ROWS, 2 * len(zeros[0]))
        ms, _ = behind()
        if top:
            streak, last = 0, top[2]
        if len(ms):
            streak = (streak + len(ms) - 1) % self.threshold + 1
        until = int(ms.max()) + self.pause_ms if len(ms) and streak == self.threshold else None
        self.state.update((streak, last))
        yield Row(label=key[0], zero_runs=streak, last_articles=last, disabled_until_ms=until)

    def close(self) -> None:
        pass


def breaker_stream(runs: DataFrame, label: str = "label", run_at: str = "run_at",
                   seen: str = "articles_seen", tie: str = "event_id", threshold: int = 5,
                   pause_hours: int = 168) -> DataFrame:
    """Breaker state per source after every micro-batch.

    Rows of a batch that a later one overrides are left out before the shuffle.  Of
    runs at one time with one ``tie``, or none, those with articles are the last.
    """
    slim = runs.select(F.col(label).alias("label"), F.unix_millis(run_at).alias("ms"),
                       F.coalesce(F.col(tie).cast("long"), F.lit(NO_TIE)).alias("tie"),
                       F.coalesce(F.col(seen), F.lit(0)).cast("long").alias("seen")
                       ).filter("ms IS NOT NULL")
    return slim.mapInArrow(ending_rows, slim.schema).groupBy("label").transformWithState(
        _Breaker(threshold, pause_hours * 3_600_000),
        "label string, zero_runs long, last_articles long, disabled_until_ms long", "update",
        "None")
