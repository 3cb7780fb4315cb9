"""What is changed in a document on its way out, and what is read back from its checker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import escaped

# Switches of the outputs, and what they are by default.
DEFAULTS = {
    "html_indent": "false", "html_justify": "false", "html_pages": "true", "html_embed": "true", "html_bookmarks": "true",
    "epub_indent": "true", "epub_justify": "false", "epub_pages": "true", "image_grayscale": "false", "image_jpeg": "false",
}
#: The deepest heading that a table of contents lists.
DEEPEST = 3


def without_markers(html: Column) -> Column:
    """Page marks taken out; the text on both sides closes up."""
    return F.regexp_replace(html, r'<(div|span)\b[^>]*\brole="doc-pagebreak"[^>]*></\1>', "")


def settings(stored: Column) -> Column:
    """Stored settings (a map, or null) over the defaults; unknown ones are ignored."""
    own = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    return F.transform_values(own, lambda k, v: F.coalesce(F.coalesce(stored, F.create_map().cast("map<string,string>"))[k], v))


def embed(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, html), (doc_id, name, content, mime) -> html with each figure's file in the text itself: a join on the name, then a fold over a document's figures."""
    listed = figures.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", F.concat(F.lit("data:"), "mime", F.lit(";base64,"), F.base64("content")).alias("uri")))).alias("_f"))
    whole = documents.join(listed, "doc_id", "left")
    put = F.aggregate(F.coalesce("_f", F.array().cast("array<struct<name:string,uri:string>>")), F.col("html"), lambda html, f: F.replace(html, F.concat(F.lit('src="figures/'), f["name"], F.lit('"')), F.concat(F.lit('src="'), f["uri"], F.lit('"'))))
    return whole.withColumn("html", put).drop("_f")


def contents(headings: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, ord, new_level, text, id or href) -> (doc_id, toc): nested lists of the headings, as deep as asked for.

    The levels have no skips, so that each entry opens one list at most and closes as many as it goes up.
    """
    place = F.col("href") if "href" in headings.columns else F.concat(F.lit("#"), "id")
    listed = headings.filter(F.col("new_level") <= deepest).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "new_level", "text", place.alias("href")))).alias("_h"))

    def add(done: Column, h: Column) -> Column:
        up = F.greatest(done["level"] - h["new_level"], F.lit(0))
        step = (
            F.when(h["new_level"] > done["level"], "<ol>")
            .otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), up)))
        )
        entry = F.concat(F.lit('<li><a href="'), escaped(h["href"]), F.lit('">'), escaped(h["text"]), F.lit("</a>"))
        return F.struct(F.concat(done["html"], step, entry).alias("html"), h["new_level"].alias("level"))

    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("level"))
    end = F.aggregate("_h", start, add)
    return listed.select("doc_id", F.concat(end["html"], F.lit("</li></ol>"), F.repeat(F.lit("</li></ol>"), end["level"] - 1)).alias("toc"))


def checker_issues(reports: DataFrame) -> DataFrame:
    """(doc_id, report), a checker's JSON -> issues: errors and fatal ones are errors, warnings warnings, the rest information; the first place only."""
    shape = "messages ARRAY<STRUCT<ID: STRING, severity: STRING, message: STRING, locations: ARRAY<STRUCT<path: STRING, line: INT>>>>"
    m = reports.select("doc_id", F.explode(F.from_json("report", shape)["messages"]).alias("m"))
    kind = F.upper("m.severity")
    severity = F.when(kind.isin("ERROR", "FATAL"), "error").when(kind == "WARNING", "warning").otherwise("info")
    place = F.get("m.locations", F.lit(0))
    return m.select("doc_id", severity.alias("severity"), F.col("m.ID").alias("code"), F.col("m.message").alias("message"), F.coalesce(F.concat_ws(":", place["path"], place["line"].cast("string")), F.lit("")).alias("location"))


def prompts(defaults: DataFrame, edits: DataFrame) -> DataFrame:
    """(name, text), (name, text, based_on) -> (name, text, customised, default_changed): edited prompts over the default ones; blank ones revert."""
    from pagewright.functions.text import clean_prompt, digest

    own = edits.select("name", clean_prompt(F.col("text")).alias("_own"), "based_on").filter("_own <> ''")
    both = defaults.join(own, "name", "left")
    customised = F.col("_own").isNotNull()
    return both.select("name", F.coalesce("_own", "text").alias("text"), customised.alias("customised"), (customised & (F.col("based_on") != digest(F.col("text")))).alias("default_changed"))


def updated(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, title, author, language) with changes of the same columns: null keeps, a blank title and a language that is none keep too."""
    from pagewright.functions.text import is_language

    new = changes.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "language")])
    both = documents.join(new, "doc_id", "left")
    title = F.when(F.trim("_title") != "", F.col("_title"))
    language = F.when(is_language(F.col("_language")), F.col("_language"))
    return both.withColumns({"title": F.coalesce(title, "title"), "author": F.coalesce("_author", "author"), "language": F.coalesce(language, "language")}).drop("_title", "_author", "_language")
