"""Document-wide lists: vocabulary, page ids, heading levels, tables of contents, chapters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.names import free_name
from pagewright.functions.text import slug

#: A word of a document's vocabulary: compounds are one.
WORD = r"[\p{L}\p{N}]+(?:[-‐][\p{L}\p{N}]+)*"


def vocabulary(texts: DataFrame) -> DataFrame:
    """(doc_id, body) -> (doc_id, word), each word of a document once, in lower case."""
    return texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(WORD), 0))).alias("word")).distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _free_names(names: pd.Series, suffix: pd.Series) -> pd.Series:
    def all_free(own: list[str], behind: str) -> list[str]:
        taken: dict[str, str] = {}
        return [free_name(n, behind, taken) for n in own]

    return pd.Series([all_free(own, behind) for own, behind in zip(names, suffix, strict=True)])


def first_free(names: Column, suffix: Column) -> Column:
    """Names made unique in order: one that is taken gets the suffix, again and again, until it is free."""
    return _free_names(names, suffix)


def page_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, label, html, skip) -> (doc_id, page_index, page_id) of the pages that are built: pg- and the label, or the number."""
    built = pages.filter(~F.col("skip") & (F.trim("html") != ""))
    named = built.select("doc_id", "page_index", F.concat(F.lit("pg-"), slug(F.coalesce(F.nullif("label", F.lit("")), F.col("page_index").cast("string")))).alias("name"))
    listed = named.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_index", "name"))).alias("_pages"))
    unique = listed.withColumn("_ids", first_free(F.transform("_pages", lambda p: p["name"]), F.lit("b")))
    return unique.select("doc_id", F.explode(F.arrays_zip("_pages", "_ids")).alias("_p")).select("doc_id", "_p._pages.page_index", F.col("_p._ids").alias("page_id"))


def without_skips(headings: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, ord, level) -> the same with new_level: at most one below the new level of the heading before.

    A fold, for each level depends on the one before it as rewritten. Before the first one the level counts as ``seed``: 1
    under a title, 0 in a table of contents, whose first entry is thereby of level 1.
    """

    def add(done: Column, level: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, F.greatest(F.size(done), F.lit(1)))).otherwise(F.lit(seed))
        return F.concat(done, F.array(F.least(level, last + 1)))

    listed = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "level"))).alias("_h"))
    folded = listed.withColumn("_new", F.aggregate(F.transform("_h", lambda h: h["level"].cast("int")), F.array().cast("array<int>"), add))
    return folded.select("doc_id", F.explode(F.arrays_zip("_h", "_new")).alias("_z")).select("doc_id", "_z._h.ord", "_z._h.level", F.col("_z._new").alias("new_level"))


def normalised(headings: DataFrame) -> DataFrame:
    """(doc_id, ord, level) -> the same with new_level: exactly one heading of level 1, the title, and no skips.

    With more than one, all go down by one, to level 6 at most, below a title that is put in before them; without any, a title
    is put in alone. A title that is put in has ord -1.
    """
    tops = headings.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("_tops"))
    moved = headings.join(tops, "doc_id").withColumn("level", F.when(F.col("_tops") > 1, F.least(F.col("level") + 1, F.lit(6))).otherwise(F.col("level")).cast("int"))
    title = tops.filter("_tops <> 1").select("doc_id", F.lit(-1).alias("ord"), F.lit(1).alias("level"))
    whole = moved.select("doc_id", "ord", "level").unionByName(title)
    return without_skips(whole)


def chapters(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, tag) -> the same with chapter: each h1 or h2 that is not the first block starts one."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    starts = F.col("tag").isin("h1", "h2") & (F.row_number().over(order) > 1)
    return blocks.withColumn("_start", starts.cast("int")).withColumn("chapter", (F.sum("_start").over(order) + 1).cast("int")).drop("_start")
