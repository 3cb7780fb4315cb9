"""Queries that go through a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.adapters import table
from pagewright.sources.places import new_folder
from pagewright.streaming import edits, jobs


def _folder(spark: SparkSession) -> str:
    """A place for a stream's checkpoint and rows."""
    return new_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, from a stream of all events."""
    last = edits.latest(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])
    return edits.run_once(last, f"latest_{uuid.uuid4().hex}", "complete", _folder(spark)).select("user_id", "event_id", "event_type")


def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits.throughput(_events(spark, sf_dir))
    whole = edits.run_once(found, f"throughput_{uuid.uuid4().hex}", "complete", _folder(spark))
    return whole.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _edits(events: DataFrame) -> DataFrame:
    base = F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 300)).cast("int")
    return events.select("event_id", F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page_index"), base.alias("base_version"))


def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: which are taken and which are stale."""
    return edits.outcomes(_edits(table(spark, sf_dir, "events")))


def stream_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stateful stream."""
    return edits.run_once(edits.outcomes(_edits(_events(spark, sf_dir))), f"conflicts_{uuid.uuid4().hex}", "append", _folder(spark))


def _jobs(events: DataFrame) -> DataFrame:
    """Events as those of jobs: a user is a document, a signup a start, a purchase an end, all else a page; every ninth names a job that never ran."""
    kind, i = F.col("event_type"), F.col("event_id")
    start = kind == "signup"
    return events.select(
        F.col("user_id").cast("string").alias("doc_id"), "event_id", F.col("ts").alias("at"), F.when(start, "start").when(kind == "purchase", "end").otherwise("page").alias("kind"),
        F.when(start, i.cast("string")).when(i % 9 == 0, "-").alias("job"), (i % 50).cast("int").alias("page"), F.when(kind == "error", "error").otherwise("done").alias("status"),
    )


DAY = 86400


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event of a job came to; a job of which nothing is heard for a day no longer runs."""
    return jobs.gate(_jobs(table(spark, sf_dir, "events")), DAY)


def stream_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream with keyed state and timers."""
    with jobs.keyed_state(spark):
        return edits.run_once(jobs.gate(_jobs(_events(spark, sf_dir)), DAY), f"jobs_{uuid.uuid4().hex}", "append", _folder(spark))


def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(stream_job_events(spark, sf_dir))


def _requests(events: DataFrame) -> DataFrame:
    """Views as requests to show a page; every third is told again late, with the time of some hours before."""
    return events.filter("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("doc_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 90 * 3_600_000_000).otherwise(0)).alias("_made"), (F.col("event_id") % 50).alias("page")
    ).select("doc_id", "event_id", F.timestamp_micros("_made").alias("at"), "page")


def view_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.requests(_requests(table(spark, sf_dir, "events"))).select("doc_id", "event_id", "page")


def stream_view_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    with jobs.keyed_state(spark):
        return edits.run_once(jobs.requests(_requests(_events(spark, sf_dir))), f"requests_{uuid.uuid4().hex}", "append", _folder(spark)).select("doc_id", "event_id", "page")


_JOBS = """WITH RECURSIVE e AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'page' END AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
      CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) WHEN event_id % 9 = 0 THEN '-' END AS named, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS runs, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS x, CAST(NULL AS TIMESTAMP) AS seen, CAST(NULL AS VARCHAR) AS job, '' AS outcome, CAST(NULL AS VARCHAR) AS last FROM e
    UNION ALL SELECT doc_id, n, event_id, CASE outcome WHEN 'started' THEN named WHEN 'ended' THEN NULL ELSE live END, CASE outcome WHEN 'started' THEN 0 WHEN 'page' THEN c + 1 ELSE c END, CASE WHEN outcome = 'started' THEN 0 WHEN outcome = 'page' AND status = 'error' THEN x + 1 ELSE x END,
      CASE WHEN outcome IN ('started', 'page') THEN ts ELSE seen END, CASE WHEN outcome IN ('started', 'unknown') THEN named ELSE live END, outcome, CASE WHEN outcome = 'page' THEN 'page ' || (event_id % 50) || ': ' || status END
    FROM (SELECT *, CASE WHEN kind = 'start' THEN CASE WHEN live IS NULL THEN 'started' ELSE 'refused' END WHEN live IS NULL OR named <> live THEN 'unknown' WHEN kind = 'end' THEN 'ended' ELSE 'page' END AS outcome
      FROM (SELECT e.*, r.c, r.x, r.seen, CASE WHEN e.ts <= r.seen + INTERVAL '24 hours' THEN r.runs END AS live FROM e JOIN r ON e.doc_id = r.doc_id AND e.n = r.n + 1) a) b),
  o AS (SELECT doc_id, event_id, job, outcome, CASE WHEN outcome <> 'unknown' THEN c END AS completed, CASE WHEN outcome <> 'unknown' THEN x END AS errors, last FROM r WHERE n > 0)"""
_ONCE = """SELECT doc_id, event_id, page FROM (SELECT *, max(made) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, epoch_us(ts) - CASE WHEN event_id % 3 = 0 THEN event_id % 90 * 3600000000 ELSE 0 END AS made, event_id % 50 AS page FROM events WHERE event_type = 'view') v) w WHERE before IS NULL OR made > before"""

_CONFLICTS = """WITH RECURSIVE e AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id // 300 AS INT) END AS base, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT doc_id, n, event_id, CASE WHEN base IS NULL OR base = 0 THEN 1 ELSE 0 END AS version, CASE WHEN base IS NULL OR base = 0 THEN 'accepted' ELSE 'conflict' END AS outcome FROM e WHERE n = 1
    UNION ALL SELECT e.doc_id, e.n, e.event_id, CASE WHEN base IS NULL OR base = r.version THEN r.version + 1 ELSE r.version END, CASE WHEN base IS NULL OR base = r.version THEN 'accepted' ELSE 'conflict' END
    FROM e JOIN r ON e.doc_id = r.doc_id AND e.n = r.n + 1)
  SELECT doc_id, 1 AS page_index, event_id, CAST(version AS INT) AS version, outcome FROM r"""

QUERIES = {
    "stream_latest": (
        stream_latest,
        "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    ),
    "stream_throughput": (stream_throughput, "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "job_events": (job_events, f"{_JOBS} SELECT * FROM o"),
    "stream_job_events": (stream_job_events, f"{_JOBS} SELECT * FROM o"),
    "stream_job_progress": (
        stream_job_progress,
        f"""{_JOBS} SELECT doc_id, job, max(completed) AS completed, max(errors) AS errors, arg_max(last, event_id) FILTER (outcome = 'page') AS last, bool_or(outcome = 'ended') AS ended, count(*) FILTER (outcome = 'refused') AS refused
        FROM o WHERE outcome <> 'unknown' GROUP BY doc_id, job""",
    ),
    "view_requests": (view_requests, _ONCE),
    "stream_view_requests": (stream_view_requests, _ONCE),
    "version_conflicts": (version_conflicts, _CONFLICTS),
    "stream_conflicts": (stream_conflicts, _CONFLICTS),
}
