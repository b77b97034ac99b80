"""Streaming twins: reading minutes, replies with thinking removed, a work queue's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import shipped

# The marks around a model's thinking, and the attempts that a page gets.
OPEN, CLOSE, ATTEMPTS = "<think>", "</think>", 3


def minutes_by_day(events: DataFrame) -> DataFrame:
    """ST02: minutes added up for each (book_id, day); for update or complete mode."""
    return events.groupBy("book_id", "day").agg(F.sum("minutes").alias("minutes"))


def minutes_by_window(events: DataFrame, late: str = "1 day") -> DataFrame:
    """An extension: the same over event time `ts`, with late rows dropped after a watermark; for append mode."""
    return events.withWatermark("ts", late).groupBy("book_id", F.window("ts", "1 day")).agg(F.sum("minutes").alias("minutes"))


def feed(pending: str, thinking: bool, more: str) -> tuple[str, str, bool]:
    """What becomes visible when more text arrives; and the tail held back, since it may begin a mark."""
    pending, shown = pending + more, ""
    while True:
        mark = CLOSE if thinking else OPEN
        at = pending.find(mark)
        if at < 0:
            held = next((n for n in range(min(len(mark) - 1, len(pending)), 0, -1) if mark.startswith(pending[-n:])), 0)
            if not thinking:
                shown += pending[: len(pending) - held]
            return shown, pending[len(pending) - held :], thinking
        if not thinking:
            shown += pending[:at]
        pending, thinking = pending[at + len(mark) :], not thinking


def visible_text(deltas: DataFrame) -> DataFrame:
    """ST03: (stream, seq, text): each reply's visible text, thinking dropped though its marks are split over deltas.

    deltas: stream, seq, delta, last. After the last one a held tail comes out, unless it is thinking.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, thinking = state.get if state.exists else ("", False)
        rows, ended = [], False
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                shown, pending, thinking = feed(pending, thinking, r.delta)
                if r.last:
                    shown, pending, ended = shown + ("" if thinking else pending), "", True
                rows.append((key[0], r.seq, shown))
        if ended:
            state.remove()
        else:
            state.update((pending, thinking))
        yield pd.DataFrame(rows, columns=["stream", "seq", "text"])

    return shipped(deltas).groupBy("stream").applyInPandasWithState(run, "stream long, seq long, text string", "pending string, thinking boolean", "append", GroupStateTimeout.NoTimeout)


def queue_states(events: DataFrame) -> DataFrame:
    """ST05: (page, status, attempts) from events (page, ok): done once one is ok, failed after three that are not."""
    counts = events.groupBy("page").agg(F.bool_or("ok").alias("ok"), F.count_if(~F.col("ok")).alias("attempts"))
    return counts.select("page", F.when(F.col("ok"), "DONE").when(F.col("attempts") >= ATTEMPTS, "FAILED").otherwise("PENDING").alias("status"), "attempts")


def refresh(stream: DataFrame, query, write):
    """ST01: a query's result written anew after each batch of changes."""
    return stream.writeStream.foreachBatch(lambda batch, _: write(query(batch)))


# Seconds that a profile rests after an error, None for good, and how long text is held back.
RESTS = {"429": 1800, "net": 300, "40x": None}
FLUSH_MS = 100


def cool_downs(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """ST10: (profile, at, state) whenever a profile's state changes: `resting`, `ready` again, or `off` for good.

    events: profile, ts, kind (429, net, 40x, or ok). A rest ends by an event-time timer, when the watermark has passed it,
    at the time it was set for; an error during a rest sets it anew, as the last one says. For append mode.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        until, off = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            rows.append((key[0], pd.Timestamp(until, unit="ms"), "ready"))
            state.remove()
        else:
            for r in sorted((r for pdf in batches for r in pdf.itertuples()), key=lambda r: r.ts):
                at = int(r.ts.timestamp() * 1000)
                if until is not None and until <= at:
                    rows.append((key[0], pd.Timestamp(until, unit="ms"), "ready"))
                    until = None
                if off or r.kind not in RESTS:
                    continue
                if RESTS[r.kind] is None:
                    until, off = None, True
                    rows.append((key[0], r.ts, "off"))
                else:
                    if until is None:
                        rows.append((key[0], r.ts, "resting"))
                    until = at + 1000 * RESTS[r.kind]
            if off or until is not None:
                state.update((until, off))
                if until is not None:
                    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(rows, columns=["profile", "at", "state"])

    marked = shipped(events).withWatermark("ts", late)
    return marked.groupBy("profile").applyInPandasWithState(run, "profile string, at timestamp, state string", "until long, off boolean", "append", GroupStateTimeout.EventTimeTimeout)


def bundled_deltas(deltas: DataFrame, flush_ms: int = FLUSH_MS) -> DataFrame:
    """ST04: (stream, first_seq, last_seq, text): a reply's deltas in bundles, each held back for so long at most.

    deltas: stream, seq, delta, last. A processing-time timer set by a bundle's first delta lets it go; the last delta of
    a stream lets all go at once, so that none stays behind. For append mode.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        first, last, text, due = state.get if state.exists else (None, None, "", None)
        now = state.getCurrentProcessingTimeMs()
        ended = False
        if not state.hasTimedOut:
            for r in sorted((r for pdf in batches for r in pdf.itertuples()), key=lambda r: r.seq):
                first, last, text, ended = r.seq if first is None else first, r.seq, text + r.delta, ended or bool(r.last)
        if first is not None and (ended or state.hasTimedOut or (due is not None and due <= now)):
            rows.append((key[0], first, last, text))
            first = None
        if first is None:
            if state.exists:
                state.remove()
        else:
            due = now + flush_ms if due is None else due
            state.update((first, last, text, due))
            state.setTimeoutDuration(max(1, due - now))
        yield pd.DataFrame(rows, columns=["stream", "first_seq", "last_seq", "text"])

    kept = "first long, last long, text string, due long"
    return shipped(deltas).groupBy("stream").applyInPandasWithState(run, "stream long, first_seq long, last_seq long, text string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)
