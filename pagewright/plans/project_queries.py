"""Queries on projects that are saved and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans.text_queries import _SLUG
from pagewright.sources import files, projects
from pagewright.sources.adapters import PAGES_SQL, pages, table
from pagewright.sources.places import new_folder


def _documents(spark: SparkSession, sf_dir: str, title: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("doc_id"), F.concat(F.lit("/scans/"), conv, F.lit(".pdf")).alias("source"), F.concat(F.lit(title), conv).alias("title"), F.lit(None).cast("string").alias("author"), F.lit("en").alias("language"), F.sha2(conv.cast("binary"), 256).alias("fingerprint")
    ).dropDuplicates(["doc_id"])


def _saved_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations saved as projects; every third is saved again with another title and a note on each page, and read back."""
    path, own = new_folder(spark, "projects"), pages(spark, sf_dir)
    projects.save(files.export_projects(_documents(spark, sf_dir, "Talk "), own), path)
    third = F.col("doc_id").cast("long") % 3 == 0
    again = own.filter(third).withColumns({"notes": F.lit("read twice"), "version": F.col("version") + 1})
    projects.save(files.export_projects(_documents(spark, sf_dir, "Second talk "), again), path)
    return projects.load(spark, path)


def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.import_pages(_saved_twice(spark, sf_dir)).select("doc_id", "error", "page_index", "label", "html", "status", "notes", "draft_text", "skip", "version")


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.documents(_saved_twice(spark, sf_dir)).select("doc_id", "source", "title", "author", "language", "fingerprint", "n_pages", "n_done")


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of the web as files that are opened, each with 1 to 4 pages: every fourth is stored by its fingerprint, every fourth by its name alone."""
    i, title = F.col("page_id"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    name, fingerprint = F.concat(title, F.lit(" "), i), F.sha2(i.cast("string").cast("binary"), 256)
    found = table(spark, sf_dir, "pages").select(
        name.alias("name"), F.col("url").alias("source"), fingerprint.alias("fingerprint"), F.transform(F.sequence(F.lit(1), (i % 4 + 1).cast("int")), lambda n: F.when(n % 2 == 0, F.concat(F.lit("p"), n)).otherwise(" ")).alias("page_labels"),
        F.when(i % 5 == 0, F.lit("Given")).alias("title"), F.lit(None).cast("string").alias("author"), F.when(i % 7 == 0, "de").alias("language"), F.when(i % 3 == 0, F.concat(F.lit("Report "), i)).otherwise("untitled").alias("meta_title"), F.lit("scanner").alias("meta_author"), i.alias("page_id"),
    )
    stored = found.filter("page_id % 4 < 2").select(
        F.when(i % 4 == 0, F.concat(F.lit("old-"), i)).otherwise(projects.text.slug(F.col("name"))).alias("doc_id"), F.lit("/lost.pdf").alias("source"), F.lit("Old").alias("title"), F.lit("A").alias("author"), F.lit("fr").alias("language"),
        F.when(i % 4 == 0, F.col("fingerprint")).alias("fingerprint"), F.lit(None).cast("timestamp").alias("opened_at"),
    )
    return projects.opened(found.drop("page_id"), stored, F.lit("2024-01-01 00:00:00").cast("timestamp"))


def opened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir)[0].select("doc_id", "source", "title", "author", "language", "fingerprint")


def opened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir)[1]


_FOUND = f"""WITH f AS (SELECT page_id, url, sha256(CAST(page_id AS VARCHAR)) AS fingerprint, {_SLUG} AS slug, name FROM (SELECT *, name AS title FROM (SELECT *, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || ' ' || page_id AS name FROM pages) q) p),
  d AS (SELECT *, regexp_replace(left(slug, 60), '-+$', '') || '-' || left(fingerprint, 8) AS new_id FROM f)"""

QUERIES = {
    "project_pages": (
        project_pages,
        f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, CAST(NULL AS VARCHAR) AS error, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS INT) AS page_index, label, html, status,
          CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 'read twice' ELSE notes END AS notes, draft_text, skip, CAST(version + CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS version FROM p""",
    ),
    "project_list": (
        project_list,
        f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, '/scans/' || doc_id || '.pdf' AS source, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 'Second talk ' ELSE 'Talk ' END || doc_id AS title, CAST(NULL AS VARCHAR) AS author, 'en' AS language, sha256(doc_id) AS fingerprint,
          CAST(count(*) AS INT) AS n_pages, CAST(count(*) FILTER (status = 'done') AS INT) AS n_done FROM p GROUP BY doc_id""",
    ),
    "opened_documents": (
        opened_documents,
        f"""{_FOUND} SELECT CASE page_id % 4 WHEN 0 THEN 'old-' || page_id WHEN 1 THEN slug ELSE new_id END AS doc_id, url AS source,
          CASE WHEN page_id % 5 = 0 THEN 'Given' WHEN page_id % 4 < 2 THEN 'Old' WHEN page_id % 3 = 0 THEN 'Report ' || page_id ELSE name END AS title, CASE WHEN page_id % 4 < 2 THEN 'A' ELSE '' END AS author,
          CASE WHEN page_id % 4 < 2 THEN 'fr' WHEN page_id % 7 = 0 THEN 'de' ELSE 'en' END AS language, fingerprint FROM d""",
    ),
    "opened_pages": (
        opened_pages,
        f"""{_FOUND} SELECT new_id AS doc_id, CAST(n AS INT) AS page_index, CASE WHEN n % 2 = 0 THEN 'p' || n END AS label, 'pending' AS status, CAST(0 AS INT) AS version
          FROM (SELECT new_id, page_id, unnest(range(1, page_id % 4 + 2)) AS n FROM d WHERE page_id % 4 >= 2) x""",
    ),
}
