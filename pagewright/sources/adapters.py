"""The test tables as documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages: the turn is the page, its text the draft; states and markup follow from the position."""
    turn, spot = F.col("turn"), F.col("conv_id") + F.col("turn")
    text = F.col("text")
    status = F.element_at(F.array(*[F.lit(s) for s in ("done", "pending", "needs_review", "done", "error")]), (spot % 5 + 1).cast("int"))
    html = F.when(spot % 7 == 0, "").otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        (turn + 1).cast("int").alias("page_index"),
        F.when(spot % 4 == 0, F.lit(None)).otherwise((turn % 3 + 1).cast("string")).alias("label"),
        html.alias("html"),
        (spot % 2 == 0).alias("starts_mid_paragraph"),
        (spot % 2 == 1).alias("ends_mid_paragraph"),
        (spot % 11 == 0).alias("skip"),
        status.alias("status"),
        F.when(spot % 6 == 0, "check this page").otherwise("").alias("notes"),
        text.alias("draft_text"),
        F.map_from_arrays(F.array(F.lit("input_tokens"), F.lit("output_tokens")), F.array(F.length(text).cast("long"), spot % 97)).alias("usage"),
        (spot % 5).cast("int").alias("version"),
    )


#: pages() in SQL.
PAGES_SQL = """
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INT) AS page_index,
    CASE WHEN (conv_id + turn) % 4 <> 0 THEN CAST(turn % 3 + 1 AS VARCHAR) END AS label,
    CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE '<p>' || text || '</p>' END AS html,
    (conv_id + turn) % 2 = 0 AS starts_mid_paragraph, (conv_id + turn) % 2 = 1 AS ends_mid_paragraph, (conv_id + turn) % 11 = 0 AS skip,
    ['done', 'pending', 'needs_review', 'done', 'error'][CAST((conv_id + turn) % 5 + 1 AS INT)] AS status,
    CASE WHEN (conv_id + turn) % 6 = 0 THEN 'check this page' ELSE '' END AS notes, text AS draft_text,
    CAST(length(text) AS BIGINT) AS input_tokens, (conv_id + turn) % 97 AS output_tokens, CAST((conv_id + turn) % 5 AS INT) AS version
  FROM conversations"""


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of pages: a user is a page, the kind of event an action, its ordinal within the page the version."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page_index"), "ts", "event_type", "value", "props")
