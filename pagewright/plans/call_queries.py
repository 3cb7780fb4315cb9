"""Queries on calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import calls
from pagewright.sources.adapters import table


def call_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed calls, each user's in turns of nine attempts: the waits by both rules."""
    i, kind = F.col("event_id"), F.col("event_type")
    attempt = (i % 9).cast("int")
    status = F.when(kind == "error", 429).when(kind == "click", 400).when(kind == "view", 503).when(kind == "signup", 404)
    said = F.when(i % 2 == 0, F.concat(F.lit("Rate Limit: "), F.col("props"))).otherwise(F.col("props"))
    after = F.when(i % 3 > 0, (i % 200).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", calls.waits(calls.GATEWAY, attempt, status, said, after).alias("gateway"), calls.waits(calls.SERVICE, attempt, status, said, after).alias("service"))


QUERIES = {
    "call_waits": (
        call_waits,
        """SELECT event_id, CAST(CASE WHEN kind = 'limit' THEN CASE WHEN k < 6 THEN least(60, 5 * pow(2, k)) END WHEN k < 2 THEN 3 * (k + 1) END AS INT) AS gateway,
          CAST(CASE WHEN kind = 'limit' THEN CASE WHEN k < 3 THEN least(120, CASE WHEN event_id % 3 > 0 THEN event_id % 200 ELSE 20 END) END WHEN kind = 'server' AND k < 3 THEN 5 * (k + 1) END AS INT) AS service
        FROM (SELECT event_id, event_id % 9 AS k, CASE WHEN event_type = 'error' OR (event_type = 'click' AND event_id % 2 = 0) THEN 'limit' WHEN event_type IN ('view', 'purchase') THEN 'server' ELSE 'client' END AS kind FROM events) e""",
    ),
}
