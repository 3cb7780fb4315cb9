"""Model replies: lenient JSON into the fixed result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import geometry, text
from pagewright.schema import MODEL_RESULT


def json_of(reply: Column) -> Column:
    """The JSON object in a reply: without code fences, else from the first brace to the last; null if neither is JSON."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?m)^```(?:json)?\s*|\s*```$", ""), F.lit(" \n\r\t"))
    within = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = F.from_json(bare, "map<string,string>")
    return F.when(F.startswith(bare, F.lit("{")) & valid.isNotNull(), bare).when(F.from_json(within, "map<string,string>").isNotNull(), within)


def result_of(json: Column) -> Column:
    """The result with all its fields: a blank label is null, the other missing fields are false or ''.

    Dot leaders in the markup collapse. A figure keeps its box only if that is four numbers; its id is freed of a leading
    ``fig:``.
    """
    raw = F.from_json(json, MODEL_RESULT)

    def figure(f: Column) -> Column:
        numbers = F.transform(f["bbox"], lambda v: v.try_cast("double"))
        good = (F.size(numbers) == 4) & ~F.exists(numbers, lambda v: v.isNull())
        return F.struct(
            F.regexp_replace(F.coalesce(f["id"], F.lit("")), "^fig:", "").alias("id"),
            F.coalesce(f["alt"], F.lit("")).alias("alt"),
            F.when(good, numbers).alias("bbox"),
            F.coalesce(f["caption"], F.lit("")).alias("caption"),
            geometry.rotation(f["rotate"]).alias("rotate"),
        )

    def flag(name: str) -> Column:
        return F.coalesce(raw[name], F.lit(False)).alias(name)

    figures = F.filter(F.coalesce(raw["figures"], F.array().cast(MODEL_RESULT["figures"].dataType)), lambda f: f.isNotNull())
    return F.struct(
        F.nullif(F.trim(raw["label"]), F.lit("")).alias("label"),
        flag("skip"),
        flag("starts_mid_paragraph"),
        flag("ends_mid_paragraph"),
        text.without_leaders(F.coalesce(raw["html"], F.lit(""))).alias("html"),
        F.transform(figures, figure).alias("figures"),
        F.coalesce(raw["notes"], F.lit("")).alias("notes"),
    )
