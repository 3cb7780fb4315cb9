"""Queries on edits of whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import saving
from pagewright.sources.adapters import PAGES_SQL, pages, table


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as edits of pages, by their numbers; two of three say which version they were made from."""
    i, text = F.col("doc_id"), F.regexp_replace("text", "[&<>]", "")
    conv, page = i % 40, F.floor(i / 40) % 8
    base = F.when(i % 3 != 0, (F.floor(i / 320) + (conv + page) % 5 + (i % 11 < 4).cast("int")).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("event_id"), conv.cast("string").alias("doc_id"), (page + 1).cast("int").alias("page_index"), base.alias("base_version"), F.when(i % 2 == 0, i.cast("string")).otherwise("").alias("label"),
        (i % 13 == 0).alias("skip"), F.lit(False).alias("starts_mid_paragraph"), (i % 2 == 0).alias("ends_mid_paragraph"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("<p><b>"), text, F.lit("</b><script>x</script></p>"))).alias("html"),
        F.when(i % 5 == 0, "look").alias("notes"), F.when(i % 4 == 0, "done").when(i % 4 == 1, "error").alias("status"), F.col("source").alias("actor"), F.lit(None).cast("timestamp").alias("at"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumns({"changed_by": F.lit("reader"), "updated_at": F.lit(None).cast("timestamp")})


def edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saving.settle(_pages(spark, sf_dir), _edits(spark, sf_dir))


def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saving.conflicts(_pages(spark, sf_dir), _edits(spark, sf_dir))


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saving.save(_pages(spark, sf_dir), _edits(spark, sf_dir)).select("doc_id", "page_index", "label", "skip", "ends_mid_paragraph", "html", "notes", "status", "version", "changed_by")


_SETTLED = f"""WITH RECURSIVE p AS ({PAGES_SQL}),
  e AS (SELECT doc_id AS event_id, CAST(doc_id % 40 AS VARCHAR) AS doc_id, CAST(doc_id // 40 % 8 + 1 AS INT) AS page_index, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id // 320 + (doc_id % 40 + doc_id // 40 % 8) % 5 + CASE WHEN doc_id % 11 < 4 THEN 1 ELSE 0 END AS INT) END AS base_version FROM documents),
  q AS (SELECT e.*, p.version AS first, row_number() OVER (PARTITION BY e.doc_id, e.page_index ORDER BY event_id) AS n FROM e LEFT JOIN p USING (doc_id, page_index)),
  r AS (SELECT event_id, doc_id, page_index, base_version, n, CASE WHEN base_version IS NULL OR base_version = first THEN first + 1 ELSE first END AS version, base_version IS NULL OR base_version = first AS ok FROM q WHERE n = 1 AND first IS NOT NULL
    UNION ALL SELECT q.event_id, q.doc_id, q.page_index, q.base_version, q.n, CASE WHEN q.base_version IS NULL OR q.base_version = r.version THEN r.version + 1 ELSE r.version END, q.base_version IS NULL OR q.base_version = r.version
    FROM q JOIN r ON q.doc_id = r.doc_id AND q.page_index = r.page_index AND q.n = r.n + 1)"""

QUERIES = {
    "edit_outcomes": (
        edit_outcomes,
        f"""{_SETTLED} SELECT event_id, doc_id, page_index, CAST(version AS INT) AS version, CASE WHEN ok THEN 'accepted' ELSE 'conflict' END AS outcome FROM r
        UNION ALL SELECT event_id, doc_id, page_index, NULL, 'no page' FROM q WHERE first IS NULL""",
    ),
    "edit_conflicts": (edit_conflicts, f"{_SETTLED} SELECT doc_id, page_index, event_id, base_version, CAST(version AS INT) AS version FROM r WHERE NOT ok"),
    "saved_pages": (
        saved_pages,
        f"""{_SETTLED}, a AS (SELECT doc_id, page_index, max(event_id) AS last, max(version) AS version, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS named FROM r WHERE ok GROUP BY doc_id, page_index),
        c AS (SELECT a.*, d.source, last % 13 = 0 AS skipped, CASE WHEN last % 7 = 0 OR regexp_replace(text, '[&<>]', '', 'g') = '' THEN '' ELSE '<p><strong>' || regexp_replace(text, '[&<>]', '', 'g') || '</strong></p>' END AS html FROM a JOIN documents d ON d.doc_id = last),
        s AS (SELECT *, html = '' AND NOT skipped AS empty, concat_ws(' | ', CASE WHEN last % 5 = 0 THEN 'look' END, CASE WHEN html = '' AND NOT skipped THEN 'the result is empty' END) AS notes FROM c)
        SELECT p.doc_id, p.page_index, CASE WHEN s.named IS NOT NULL THEN CAST(s.named AS VARCHAR) ELSE p.label END AS label, coalesce(s.skipped, p.skip) AS skip,
          CASE WHEN s.last IS NULL THEN p.ends_mid_paragraph ELSE s.last % 2 = 0 END AS ends_mid_paragraph, coalesce(s.html, p.html) AS html, CASE WHEN s.last IS NULL THEN p.notes ELSE s.notes END AS notes,
          CASE WHEN s.last IS NULL THEN p.status WHEN s.last % 4 = 0 THEN CASE WHEN s.empty THEN 'pending' ELSE 'done' END WHEN s.empty OR s.notes <> '' THEN 'needs_review' ELSE 'done' END AS status,
          CAST(coalesce(s.version, p.version) AS INT) AS version, CASE WHEN s.last IS NULL THEN 'reader' ELSE s.source END AS changed_by
        FROM p LEFT JOIN s USING (doc_id, page_index)""",
    ),
}
