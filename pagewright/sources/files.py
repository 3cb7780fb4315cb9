"""Files: fingerprints of originals, portable projects, written documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.schema import PAGES

# What a fingerprint covers, and what a project file is.
SAMPLED = 1_000_000
FORMAT, VERSION = "pagewright-project", 1


def originals(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, modified) of the files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.col("modificationTime").alias("modified"))


def fingerprint(content: Column) -> Column:
    """16 hexadecimal digits over size, first and last megabyte."""
    size = F.octet_length(content)
    tail_at = F.greatest(F.lit(SAMPLED), size - SAMPLED) + 1
    tail = F.when(size > SAMPLED, F.substr(content, tail_at, F.lit(SAMPLED))).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(content, 1, SAMPLED), tail), 256), 1, 16)


def register(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose fingerprint no document has."""
    return found.withColumn("fingerprint", fingerprint(F.col("content"))).join(documents.select("fingerprint"), "fingerprint", "left_anti")


def blank_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page_count) -> a pending page for each page of the original."""
    return documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_index"), F.lit("pending").alias("status"), F.lit(0).alias("version"))


def export_projects(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, project): each document with its pages, in order, as one JSON text."""
    page = F.struct("page_index", *[c for c in pages.columns if c not in ("doc_id", "page_index")])
    # A page's number comes first, and maps, which have no order, are never compared.
    listed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page_index"] - b["page_index"]).alias("pages"))
    whole = F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), *[c for c in documents.columns if c != "doc_id"], "pages")
    return documents.join(listed, "doc_id").select("doc_id", F.to_json(whole).alias("project"))


def import_pages(projects: DataFrame) -> DataFrame:
    """(doc_id, project) -> its pages, or one row that says why not in ``error``: the first test that fails.

    Unknown fields are dropped, and a page's number is its place.
    """
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in PAGES if f.name not in ("doc_id", "page_index"))
    shape = f"format STRING, version STRING, pages ARRAY<STRUCT<{fields}>>"
    read = projects.select("doc_id", F.from_json("project", shape).alias("p"))
    version = F.col("p.version").try_cast("int")
    error = (
        F.when(F.coalesce(F.col("p.format"), F.lit("")) != FORMAT, "not a project")
        .when(version.isNull() | (version > VERSION), "version not known")
        .when(F.col("p.pages").isNull(), "no pages")
    )
    placed = read.withColumn("error", error).select("doc_id", "error", F.posexplode_outer(F.when(error.isNull(), F.col("p.pages"))).alias("_at", "_page"))
    return placed.select("doc_id", "error", (F.col("_at") + 1).alias("page_index"), "_page.*")


def write_documents(built: DataFrame, path: str, partitions: int | None = None) -> None:
    """(name, html) -> a folder for each document's name with its markup; the committer makes it appear whole."""
    dealt = built.repartition(partitions, "name") if partitions else built.repartition("name")
    dealt.write.mode("overwrite").partitionBy("name").text(path)
