"""Queries on draft text and word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import drafts
from pagewright.sources.adapters import pages, table
from pagewright.sources.places import new_folder


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: one of three has a text layer of all its words, one a stamp in it, one none; lines stand out of order on the images.

    The table of drafts is filled for half of the documents first and for all after.
    """
    spot = F.col("conv_id") + F.col("turn")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_index"), (spot % 3).alias("kind"), "text")
    layer_text = own.filter("kind > 0").select("doc_id", "page_index", F.when(F.col("kind") == 1, F.col("text")).otherwise("Scan").alias("text"))
    p = F.col("p")
    layer = layer_text.select("doc_id", "page_index", F.posexplode(F.split("text", r"\s+")).alias("p", "text")).select(
        "doc_id", "page_index", F.floor(p / 40).alias("block"), F.floor(p / 8 % 5).alias("line"), (p % 8).alias("word_no"), F.when(p % 11 == 10, " ").otherwise(F.col("text")).alias("text"),
        (p % 8 * 80.0 - 10.0).alias("x0"), (F.floor(p / 8) * 14.0).alias("y0"), (p % 8 * 80.0 + 62.0).alias("x1"), (F.floor(p / 8) * 14.0 + 12.0).alias("y1"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
    )
    l = F.col("l")  # noqa: E741
    lines = own.select("doc_id", "page_index", F.posexplode(F.split("text", "\n")).alias("l", "text")).filter(F.rlike("text", F.lit(r"\S"))).select(
        "doc_id", "page_index", "text", (l * 3.0).alias("x0"), (l * 37 % 101 * 6.0).alias("y0"), (l * 3.0 + 900.0).alias("x1"), (l * 37 % 101 * 6.0 + 10.0).alias("y1"), F.lit(1200.0).alias("width"), F.lit(1600.0).alias("height")
    )

    def compute(missing: DataFrame) -> DataFrame:
        return drafts.drafts(missing, layer_text, layer, lambda chosen: lines.join(chosen, ["doc_id", "page_index"], "left_semi"))

    marked = pages(spark, sf_dir).select("doc_id", "page_index", F.sha2(F.col("doc_id").cast("binary"), 256).alias("fingerprint"))
    path = new_folder(spark, "drafts")
    drafts.kept(marked.filter(F.col("doc_id").cast("long") % 2 == 0), path, compute)
    return drafts.kept(marked, path, compute)


def draft_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("doc_id", "page_index", "draft_text", "draft_source")


def draft_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = _drafts(spark, sf_dir).select("doc_id", "page_index", F.posexplode("words").alias("pos", "w"))
    return boxed.select("doc_id", "page_index", "pos", "w.text", *[F.round(f"w.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_DRAFTS = rf"""WITH o AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INT) AS page_index, (conv_id + turn) % 3 AS kind, text FROM conversations),
  l AS (SELECT doc_id, page_index, kind, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS l FROM (SELECT *, string_split(text, chr(10)) AS ls FROM o) q),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY round_even(l * 37 % 101 * 6.0::DOUBLE / 12, 0), l) AS n FROM l WHERE regexp_matches(text, '\S')),
  k AS (SELECT o.*, kind = 1 AND length(text) >= 40 AS enough FROM o)"""

QUERIES = {
    "draft_texts": (
        draft_texts,
        f"""{_DRAFTS} SELECT doc_id, page_index, CASE WHEN enough THEN k.text ELSE coalesce(t.text, '') END AS draft_text, CASE WHEN enough THEN 'textlayer' ELSE 'ocr' END AS draft_source
          FROM k LEFT JOIN (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY n) AS text FROM n GROUP BY doc_id, page_index) t USING (doc_id, page_index)""",
    ),
    "draft_words": (
        draft_words,
        rf"""{_DRAFTS}, w AS (SELECT doc_id, page_index, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS p FROM (SELECT *, regexp_split_to_array(text, '\s+') AS ws FROM o WHERE kind = 1) q),
          v AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, page_index) - 1 AS total FROM w WHERE text <> '' AND p % 11 <> 10),
          a AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY p) - 1 AS pos, text, p % 8 * 80.0::DOUBLE AS x, p // 8 * 14.0::DOUBLE AS y FROM v WHERE total >= 40),
          t AS (SELECT doc_id, page_index, n, l, unnest(ws) AS text, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\S+') AS ws FROM n ANTI JOIN a USING (doc_id, page_index)) q),
          s AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_index, n ORDER BY i) AS DOUBLE) AS upto, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_index, n) - 1 AS DOUBLE) AS total FROM t)
        SELECT doc_id, page_index, CAST(pos AS INT) AS pos, text, round(greatest(0, least(1000, (x - 10) / 612 * 1000)), 6) AS x0, round(least(1000, y / 792 * 1000), 6) AS y0, round(least(1000, (x + 62) / 612 * 1000), 6) AS x1, round(least(1000, (y + 12) / 792 * 1000), 6) AS y1 FROM a
        UNION ALL SELECT doc_id, page_index, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n, i) - 1 AS INT), text, round(l * 2.5::DOUBLE + (upto - length(text) - 1) * (750.0::DOUBLE / total), 6), round(l * 37 % 101 * 6.0::DOUBLE / 1.6, 6),
          round(l * 2.5::DOUBLE + upto * (750.0::DOUBLE / total), 6), round((l * 37 % 101 * 6.0::DOUBLE + 10) / 1.6, 6) FROM s""",
    ),
}
