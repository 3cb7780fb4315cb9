"""How much of each page's draft text its transcription holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import n_words

# Fixed values.
LOW, HIGH, FEWEST = 0.6, 1.6, 30


def coverage(pages: DataFrame, low: float = LOW, high: float = HIGH, fewest: int = FEWEST) -> DataFrame:
    """Issues of the pages: untranscribed, failed, skipped with text, too little or too much text, and notes left by a model.

    The first three exclude the rest, in this order; a note is reported beside the amount of text.
    """
    draft, html = n_words(F.col("draft_text")), n_words(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    ratio = F.col("_html") / F.col("_draft")
    measured = pages.withColumns({"_draft": draft, "_html": html})
    first = (
        F.when(F.col("status") == "pending", F.struct(F.lit("error").alias("severity"), F.lit("untranscribed").alias("code")))
        .when(F.col("status") == "error", F.struct(F.lit("error").alias("severity"), F.lit("page-error").alias("code")))
        .when(F.col("skip"), F.when(F.col("_draft") > fewest, F.struct(F.lit("warning").alias("severity"), F.lit("skipped-with-text").alias("code"))))
        .when((F.col("_draft") >= fewest) & (ratio < low), F.struct(F.lit("warning").alias("severity"), F.lit("under-coverage").alias("code")))
        .when((F.col("_draft") >= fewest) & (ratio > high), F.struct(F.lit("warning").alias("severity"), F.lit("over-coverage").alias("code")))
    )
    settled = F.col("status").isin("pending", "error") | F.col("skip")
    noted = ~settled & (F.col("status") == "needs_review") & (F.trim(F.coalesce("notes", F.lit(""))) != "")
    note = F.when(noted, F.struct(F.lit("info").alias("severity"), F.lit("model-note").alias("code")))
    found = measured.select("doc_id", "page_index", F.explode(F.array_compact(F.array(first, note))).alias("_issue"))
    return found.select("doc_id", "page_index", "_issue.severity", "_issue.code", F.concat(F.lit("page "), "page_index").alias("location"))
