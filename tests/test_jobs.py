import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.streaming import edits, jobs

EVENTS = "doc_id string, event_id long, at timestamp, kind string, job string, page int, status string"
HOUR = 3600


def moment(hours):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=hours)


# (document, number, hours, kind, job, page, status) and what each comes to.
STORY = [
    (("d", 1, 0.0, "page", None, 1, "done"), (None, "unknown", None, None, None)),
    (("d", 2, 0.1, "start", "one", None, None), ("one", "started", 0, 0, None)),
    (("d", 3, 0.2, "page", None, 4, "done"), ("one", "page", 1, 0, "page 4: done")),
    (("d", 4, 0.3, "start", "two", None, None), ("one", "refused", 1, 0, None)),
    (("e", 5, 0.3, "start", "three", None, None), ("three", "started", 0, 0, None)),
    (("d", 6, 0.4, "page", "two", 5, "done"), ("two", "unknown", None, None, None)),
    (("d", 7, 0.5, "page", "one", 5, "error"), ("one", "page", 2, 1, "page 5: error")),
    (("d", 8, 0.6, "pause", "one", None, None), ("one", "unknown", None, None, None)),
    (("d", 9, 1.5, "end", "one", None, None), ("one", "ended", 2, 1, None)),
    (("d", 10, 1.6, "start", "four", None, None), ("four", "started", 0, 0, None)),
    (("d", 11, 2.7, "page", "four", 1, "done"), ("four", "unknown", None, None, None)),
    (("d", 12, 2.8, "start", "five", None, None), ("five", "started", 0, 0, None)),
    (("e", 13, 4.0, "start", "six", None, None), ("six", "started", 0, 0, None)),
    (("e", 14, 5.0, "end", None, None, None), ("six", "ended", 0, 0, None)),
]


def rows(spark, story):
    return spark.createDataFrame([(d, n, moment(h), *rest) for d, n, h, *rest in story], EVENTS)


def told(found):
    return {r["event_id"]: (r["job"], r["outcome"], r["completed"], r["errors"], r["last"]) for r in found.collect()}


EXPECTED = {event[1]: outcome for event, outcome in STORY}


def test_one_job_runs_for_a_document(spark):
    events = rows(spark, [e for e, _ in STORY])
    odd = rows(spark, [(None, 90, 0.0, "start", "x", None, None), ("d", None, 0.0, "start", "x", None, None)])
    found = jobs.gate(events.union(odd).withColumn("_at", F.lit("clash")), HOUR)
    assert told(found) == EXPECTED
    assert told(jobs.gate(events.limit(0), HOUR)) == {}
    counts = {(r["doc_id"], r["job"]): (r["completed"], r["errors"], r["last"], r["ended"], r["refused"]) for r in jobs.progress(found).collect()}
    assert counts[("d", "one")] == (2, 1, "page 5: error", True, 1)
    assert counts[("d", "four")] == (0, 0, None, False, 0)
    assert ("d", "two") not in counts


@pytest.mark.parametrize("batch", [1, 3])
def test_frames_cut_nothing(spark, batch):
    """Arrow batches of one row end within a document."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert told(jobs.gate(rows(spark, [e for e, _ in STORY]), HOUR)) == EXPECTED
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def stream(spark, tmp_path, parts, schema):
    """Each part as a file, and a batch, of its own, in their order."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))


def test_a_stream_tells_the_same_whatever_its_batches(spark, tmp_path):
    own = [e for e, _ in STORY]
    events = stream(spark, tmp_path, [rows(spark, own[i : i + 4]) for i in range(0, len(own), 4)], EVENTS)
    with jobs.keyed_state(spark):
        found = edits.run_once(jobs.gate(events, HOUR), "gate_test", "append", str(tmp_path / "state"))
    assert told(found) == EXPECTED


def test_time_limits_go_with_their_last_event():
    """The timer is set to the first millisecond at which the job no longer runs."""
    running = jobs.Running("a", 0, 0, 1_000_499)
    due = jobs._expires(running, 1_000_000) * 1000
    assert jobs.step(running, "page", None, 1, "done", 2_000_499, 1_000_000)[1][1] == "page"
    assert due > 2_000_499 and jobs.step(running, "page", None, 1, "done", due, 1_000_000)[1][1] == "unknown"


REQUESTS = "doc_id string, event_id long, at timestamp, `_page` int, `a.b` string, made string"


def asked(spark, story):
    return spark.createDataFrame([(d, n, None if h is None else moment(h), n, "x", "y") for d, n, h in story], REQUESTS)


ASKED = [("d", 1, 5.0), ("d", 2, 4.0), ("d", 3, 5.0), ("e", 4, 1.0), ("d", 5, 6.0), ("d", 6, 5.5), ("d", 7, None), ("e", 8, 1.0), ("e", 9, 2.0), (None, 10, 9.0)]


def test_requests_count_once(spark, tmp_path):
    found = jobs.requests(asked(spark, ASKED))
    assert found.columns == ["doc_id", "event_id", "at", "_page", "a.b", "made"]
    assert sorted(r["event_id"] for r in found.collect()) == [1, 4, 5, 9]
    assert jobs.requests(asked(spark, ASKED).limit(0)).count() == 0
    told_again = stream(spark, tmp_path, [asked(spark, ASKED[:3]), asked(spark, ASKED[3:7]), asked(spark, ASKED[1:])], REQUESTS)
    with jobs.keyed_state(spark):
        streamed = edits.run_once(jobs.requests(told_again), "once_test", "append", str(tmp_path / "state"))
    got = pd.DataFrame([r.asDict() for r in streamed.collect()])
    assert sorted(got["event_id"]) == [1, 4, 5, 9] and list(got["_page"]) == list(got["event_id"])


class Kept:
    """A document's state and timers, and what was asked of them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.asked.append("exists")
        return self.value is not None

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def clear(self):
        self.asked.append("clear")
        self.value = None

    def listTimers(self):
        self.asked.append("list")
        return iter(self.timers)

    def deleteTimer(self, at):
        self.asked.append("delete")
        self.timers.remove(at)

    def registerTimer(self, at):
        self.asked.append("register")
        self.timers.append(at)


def frame(*story):
    """(number, hours, kind, job, page, status) of one document's events."""
    own = pd.DataFrame([("d", n, moment(h), *rest) for n, h, *rest in story], columns=["doc_id", "event_id", "at", "kind", "job", "page", "status"])
    return own.assign(micros=[int(h * 3600 * 1_000_000) for _, h, *_ in story])


def test_a_document_asks_no_more_of_its_state_than_it_needs():
    kept, gate = Kept(), jobs._Gate(HOUR * 1_000_000)
    gate.init(kept)

    def batch(*frames):
        kept.asked.clear()
        found = pd.concat(list(gate.handleInputRows(("d",), iter(frames), None)))
        return list(found["outcome"]), list(kept.asked)

    assert batch(frame((1, 0.0, "page", None, 1, "done"))) == (["unknown"], ["get"])
    assert batch(frame((3, 0.2, "page", "a", None, None)), frame((2, 0.1, "start", "a", None, None))) == (["started", "page"], ["get", "update", "register"])
    assert batch(frame((4, 0.3, "start", "b", None, None), (5, 0.3, "page", "b", 1, "done"))) == (["refused", "unknown"], ["get"])
    assert kept.value == ("a", 1, 0, 720_000_000) and kept.timers == [4_320_001]
    assert batch(frame((6, 0.4, "page", "a", 1, "error"))) == (["page"], ["get", "list", "delete", "update", "register"])
    assert kept.value == ("a", 2, 1, 1_440_000_000) and kept.timers == [5_040_001]
    assert batch(frame((7, 0.5, "end", None, None, None))) == (["ended"], ["get", "list", "delete", "clear"])
    assert kept.value is None and kept.timers == []


def test_many_rows_of_a_document_come_out_in_pieces():
    n, kept, gate = 25_000, Kept(), jobs._Gate(HOUR * 1_000_000)
    gate.init(kept)
    whole = frame((0, 0.0, "start", "a", None, None), *[(i, i / 100_000, "page", None, i, "done") for i in range(1, n)])
    given = list(gate.handleInputRows(("d",), iter([whole.iloc[i : i + 10_000] for i in (20_000, 0, 10_000)]), None))
    assert max(map(len, given)) <= 10_000 and sum(map(len, given)) == n
    assert list(pd.concat(given)["event_id"]) == list(range(n)) and list(pd.concat(given)["completed"]) == list(range(n))
    assert kept.value[:3] == ("a", n - 1, 0)


@pytest.mark.parametrize("none", [None, float("nan"), pd.NA, pd.NaT])
def test_missing_values(none):
    assert jobs._plain(pd.Series(["x", none, 2], dtype=object)) == ["x", None, 2]
