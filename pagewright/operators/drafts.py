"""Draft text and word boxes of pages: from the text layer where it says enough, else from recognised lines; worked out once for each page of an original."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import PAGE, scaled
from pagewright.operators import align

# The least text of a layer that counts, and the height within which recognised lines are on one row.
ENOUGH = 40
ROW = 12

PAGE_KEY = ["doc_id", "page_index"]
BOX = "struct<text: string, x0: double, y0: double, x1: double, y1: double>"
DRAFTS = f"fingerprint string, page_index int, draft_text string, draft_source string, words array<{BOX}>"
#: (pages: doc_id, page_index) -> their lines as recognised: with text, x0, y0, x1, y1 in pixels, width and height of the image.
Recogniser = Callable[[DataFrame], DataFrame]


def _boxes(order: list[str]) -> Column:
    """Words of a page in their order, in one aggregation."""
    box = F.struct("text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, box.alias("box")))), lambda w: w["box"])


def layer_words(layer: DataFrame) -> DataFrame:
    """(doc_id, page_index, block, line, word_no, text, x0, y0, x1, y1, width, height) -> (doc_id, page_index, words).

    Boxes are on a page of 1000 by 1000 and held within it; blank words go. Words are in the order of block, line and number, ties
    in that of their text and box.
    """
    told = layer.filter(F.trim("text") != "").withColumns({c: scaled(F.col(c), F.col("width" if c[0] == "x" else "height")) for c in ("x0", "y0", "x1", "y1")})
    return told.groupBy(*PAGE_KEY).agg(_boxes(["block", "line", "word_no"]).alias("words"))


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines with their place on the page in ``line``: rows from above, half a row to the even one, and in a row from the left; ties by text."""
    order = Window.partitionBy(*PAGE_KEY).orderBy(F.bround(F.col("y0") / ROW), "x0", "text", "y0")
    return lines.withColumn("line", F.row_number().over(order) - 1)


def recognised(lines: DataFrame) -> DataFrame:
    """Recognised lines -> (doc_id, page_index, draft_text, words): the lines in their order, and each line's box shared out to its words."""
    placed = ordered_lines(lines)
    texts = placed.groupBy(*PAGE_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("draft_text"))
    on_page = placed.withColumns({c: F.col(c) / F.col("width" if c[0] == "x" else "height") * PAGE for c in ("x0", "y0", "x1", "y1")})
    words = align.line_words(on_page).withColumnRenamed("word", "text").groupBy(*PAGE_KEY).agg(_boxes(["line", "word_no"]).alias("words"))
    return texts.join(words, PAGE_KEY, "left")


def drafts(pages: DataFrame, layer_text: DataFrame, layer: DataFrame, recognise: Recogniser) -> DataFrame:
    """(doc_id, page_index) -> the same with draft_text, draft_source and words, one row a page.

    The text layer's text counts from 40 characters on, and its words where they come to as many with a space between; a page that
    lacks either is recognised, and no other. ``layer_text``: doc_id, page_index, text. A page without lines has an empty draft.
    """
    said = layer_text.select(*PAGE_KEY, F.col("text").alias("layer_text"))
    told = pages.select(*PAGE_KEY).distinct().join(said, PAGE_KEY, "left").join(layer_words(layer).withColumnRenamed("words", "layer_words"), PAGE_KEY, "left")
    spelled = F.array_join(F.transform("layer_words", lambda w: w["text"]), " ")
    text_counts, words_count = F.length(F.coalesce("layer_text", F.lit(""))) >= ENOUGH, F.length(F.coalesce(spelled, F.lit(""))) >= ENOUGH
    told = told.withColumns({"text_counts": text_counts, "words_count": words_count})
    # Recognition is dear, so that pages are chosen before it rather than its result after.
    found = recognised(recognise(told.filter("NOT (text_counts AND words_count)").select(*PAGE_KEY)))
    met = told.join(found, PAGE_KEY, "left")
    return met.select(
        *PAGE_KEY, F.when(F.col("text_counts"), F.col("layer_text")).otherwise(F.coalesce("draft_text", F.lit(""))).alias("draft_text"), F.when(F.col("text_counts"), "textlayer").otherwise("ocr").alias("draft_source"),
        F.when(F.col("words_count"), F.col("layer_words")).otherwise(F.coalesce("words", F.array().cast(f"array<{BOX}>"))).alias("words"),
    )


def kept(pages: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, page_index, fingerprint) -> the same with what ``compute`` makes of a page (DRAFTS), taken from the table at ``path`` where it is there.

    What is missing is worked out and added to the table first, by a write that counts whole. Pages are known by their original's
    fingerprint and place, so that a changed file is read anew and a renamed one is not; of two documents with one
    fingerprint the one of the least id is read. Pages without a fingerprint, and rows that runs at one time add twice, are left out.
    """
    spark, key = pages.sparkSession, ["fingerprint", "page_index"]
    spark.createDataFrame([], DRAFTS).write.mode("ignore").parquet(path)
    wanted = pages.select("doc_id", *key).dropna()
    there = spark.read.schema(DRAFTS).parquet(path)
    missing = wanted.join(there.select(*key), key, "left_anti").groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
    if not missing.isEmpty():
        made = missing.join(compute(missing.select(*PAGE_KEY)), PAGE_KEY)
        made.select("fingerprint", F.col("page_index").cast("int").alias("page_index"), "draft_text", "draft_source", F.col("words").cast(f"array<{BOX}>").alias("words")).write.mode("append").parquet(path)
    return wanted.distinct().join(spark.read.schema(DRAFTS).parquet(path).dropDuplicates(key), key)
