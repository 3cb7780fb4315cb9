"""Jobs as streams: one that runs for each document, its progress, and requests that count once.

``step`` says what an event does; a table is folded in the order of its events, and a stream keeps the running job of each document
as state, with a timer that forgets a job of which nothing has been heard, so that a lost machine locks no document for ever.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "doc_id string, event_id long, job string, outcome string, completed long, errors long, last string"
_COLUMNS = ["doc_id", "event_id", "job", "outcome", "completed", "errors", "last"]
_RUNNING = "job string, completed long, errors long, seen long"
_LATEST = "at long"
#: Rows of one document that a stream gives out at once.
_TOLD_AT_ONCE = 10_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Running(NamedTuple):
    job: str
    completed: int
    errors: int
    seen: int


def step(running: Running | None, kind: str | None, job: str | None, page: int | None, status: str | None, at: int, patience: int) -> tuple[Running | None, tuple]:
    """What runs after an event, and (job, outcome, completed, errors, last) of the event.

    ``start``: 'started', or 'refused' with the job that runs. ``page`` and ``end``: 'page' and 'ended' with the counts so far, or
    'unknown' where their job is not the one that runs; without a job they are of whichever runs. A job runs until its end, or
    until nothing was heard of it for longer than ``patience``; a refused start is nothing heard of it. Times are in microseconds.
    """
    if running and at > running.seen + patience:
        running = None
    if kind == "start":
        if running:
            return running, (running.job, "refused", running.completed, running.errors, None)
        return Running(job or "", 0, 0, at), (job or "", "started", 0, 0, None)
    if kind not in ("page", "end") or running is None or (job is not None and job != running.job):
        return running, (job, "unknown", None, None, None)
    if kind == "end":
        return None, (running.job, "ended", running.completed, running.errors, None)
    running = Running(running.job, running.completed + 1, running.errors + (status == "error"), max(at, running.seen))
    return running, (running.job, "page", running.completed, running.errors, f"page {page}: {status}")


def _plain(column: pd.Series) -> list:
    """The values of a column, with None for any that is missing."""
    return [None if v is None or v is pd.NA or v != v else v for v in column.tolist()]


def _fold(doc_id: str, frame: pd.DataFrame, running: Running | None, patience: int) -> tuple[pd.DataFrame, Running | None]:
    """What each event of one document came to, and what runs after them."""
    told = []
    events = zip(frame["event_id"].tolist(), _plain(frame["kind"]), _plain(frame["job"]), _plain(frame["page"]), _plain(frame["status"]), frame["micros"].tolist(), strict=True)
    for event_id, kind, job, page, status, at in events:
        running, row = step(running, kind, job, None if page is None else int(page), status, int(at), patience)
        told.append((doc_id, event_id, *row))
    # The types are known: finding them out for each document would cost more than its rows.
    return pd.DataFrame(told, columns=_COLUMNS, dtype=object), running


def _in_order(frames: list[pd.DataFrame]) -> pd.DataFrame:
    whole = frames[0] if len(frames) == 1 else pd.concat(frames)
    return whole if whole["event_id"].is_monotonic_increasing else whole.sort_values("event_id", ignore_index=True)


class _Gate(StatefulProcessor):
    """The running job of a document."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", _RUNNING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(list(rows))
        # Each call on the state or a timer is a question to the JVM. A document has a timer only while a job runs for it.
        known = self.running.get()
        before = after = Running(*known) if known else None
        for start in range(0, len(frame), _TOLD_AT_ONCE):
            told, after = _fold(key[0], frame.iloc[start : start + _TOLD_AT_ONCE], after, self.patience)
            yield told
        if after != before:
            for timer in list(self.handle.listTimers()) if before else ():
                self.handle.deleteTimer(timer)
            if after:
                self.running.update(tuple(after))
                self.handle.registerTimer(_expires(after, self.patience))
            else:
                self.running.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.running.clear()
        yield from ()

    def close(self) -> None:
        pass


def _expires(running: Running, patience: int) -> int:
    """The first whole millisecond at which the job no longer runs: the watermark passes it only when no event that it could take can come."""
    return math.floor((running.seen + patience) / 1000) + 1


def gate(events: DataFrame, patience_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(doc_id, event_id, at, kind, job, page, status) -> what each event came to: OUT. For tables and streams.

    Events of a document count in the order of their ids; rows without a document, id or time are left out. A stream's batch of one
    document is in memory at once, which files a trigger bound; a table is folded frame by frame.
    """
    patience = patience_seconds * 1_000_000
    at = F.col("at").cast("timestamp")
    timed = events.select("doc_id", "event_id", at.alias("at"), "kind", "job", "page", "status", F.unix_micros(at).alias("micros")).dropna(subset=["doc_id", "event_id", "at"])
    if timed.isStreaming:
        return timed.withWatermark("at", late).groupBy("doc_id").transformWithStateInPandas(_Gate(patience), OUT, "Append", "EventTime")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, running = None, None
        for frame in frames:
            # Runs of one document follow each other; the last of a frame may go on in the next.
            for doc_id, own in frame.groupby("doc_id", sort=False):
                told, running = _fold(doc_id, own, running if doc_id == document else None, patience)
                document = doc_id
                yield told

    return timed.repartition("doc_id").sortWithinPartitions("doc_id", "event_id").mapInPandas(whole, OUT)


def progress(outcomes: DataFrame) -> DataFrame:
    """(doc_id, job) with pages completed, errors, the last page's line, whether it has ended, and starts refused while it ran."""
    own = F.col("outcome").isin("started", "page", "ended")
    latest = F.max_by(F.struct("completed", "errors"), F.when(own, F.col("event_id")))
    last = F.max_by("last", F.when(F.col("outcome") == "page", F.col("event_id")))
    counted = outcomes.filter("outcome != 'unknown'").groupBy("doc_id", "job")
    found = counted.agg(latest.alias("_n"), last.alias("last"), F.bool_or(F.col("outcome") == "ended").alias("ended"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    return found.select("doc_id", "job", "_n.completed", "_n.errors", "last", "ended", "refused")


class _Once(StatefulProcessor):
    """The time of the last request that counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", _LATEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("event", ignore_index=True)
        highest = frame["micros"].cummax().shift()
        if self.latest.exists():
            before = self.latest.get()[0]
            highest = highest.fillna(before).clip(lower=before)
        taken = frame[highest.isna() | (frame["micros"] > highest)]
        if len(taken):
            self.latest.update((int(taken["micros"].iloc[-1]),))
        yield taken.drop(columns=["document", "event", "micros"])

    def close(self) -> None:
        pass


def requests(events: DataFrame) -> DataFrame:
    """(doc_id, event_id, at, ...) -> the requests that a viewer follows: those made later than any before them, in the order of their ids.

    A request that is told again has the time that it had, and counts once. Rows without a document, id or time are left out.
    """
    told = events.dropna(subset=["doc_id", "event_id", "at"])
    made = F.unix_micros(F.col("at").cast("timestamp"))
    if events.isStreaming:
        # Columns travel under plain names: those that begin with an underscore would not keep theirs.
        plain = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{n}") for n, c in enumerate(events.columns)]
        keyed = told.select(F.col("doc_id").alias("document"), F.col("event_id").alias("event"), made.alias("micros"), *plain)
        out = T.StructType([T.StructField(f"c{n}", f.dataType) for n, f in enumerate(events.schema)])
        return keyed.groupBy("document").transformWithStateInPandas(_Once(), out, "Append", "None").toDF(*events.columns)
    before = F.max(made).over(Window.partitionBy("doc_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return told.select(F.struct("*").alias("row"), made.alias("made"), before.alias("before")).filter("before IS NULL OR made > before").select("row.*")


class keyed_state:
    """While it lasts, streams of a session keep their state in RocksDB, which states with timers need."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, _ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(self.KEY)
        else:
            self.conf.set(self.KEY, self.before)
