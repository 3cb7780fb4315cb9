"""Images in markup and the figures that they show: looked up by a join, and written back in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text

IMAGE = r"(?i)<img\b[^>]*>"


def _value(tag: Column, name: str) -> Column:
    """An attribute of a tag as it stands in markup; null if the tag has none of the name."""
    return F.when(F.rlike(tag, F.lit(rf'(?i)\s{name}="')), F.regexp_extract(tag, rf'(?i)\s{name}="([^"]*)"', 1))


def _plain(value: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(plain))
    return value


def _known(figures: DataFrame, suffix: str) -> DataFrame:
    """(doc_id, page_index, fig_id, file, alt): a figure once a page, with a file if it has a box."""
    boxed = F.size(F.coalesce("bbox", F.array().cast("array<double>"))) == 4
    once = figures.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.regexp_replace("id", "^fig:", "").alias("fig_id"), F.coalesce("alt", F.lit("")).alias("alt"), boxed.alias("boxed"))
    once = once.filter(F.col("fig_id").isNotNull()).groupBy("doc_id", "page_index", "fig_id").agg(F.max(F.struct("boxed", "alt")).alias("_f"))
    name = F.concat(F.format_string("p%03d-", "page_index"), text.slug(F.col("fig_id")), F.lit(suffix))
    return once.select("doc_id", "page_index", "fig_id", F.when(F.col("_f.boxed"), name).alias("file"), F.col("_f.alt").alias("alt"))


def images(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, html) -> (doc_id, page_index, nth, tag, fig_id, alt) of each image, in the order of the page."""
    found = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.posexplode(F.regexp_extract_all("html", F.lit(IMAGE), 0)).alias("nth", "tag"))
    source = F.regexp_replace(_plain(F.coalesce(_value(F.col("tag"), "src"), F.lit(""))), "^fig:", "")
    return found.select("doc_id", "page_index", "nth", "tag", source.alias("fig_id"), _plain(F.coalesce(_value(F.col("tag"), "alt"), F.lit(""))).alias("alt"))


def lookup(pages: DataFrame, figures: DataFrame, suffix: str = ".png") -> DataFrame:
    """(doc_id, page_index, html) and (doc_id, page_index, id, alt, bbox) -> (doc_id, page_index, nth, fig_id, shown_as, file, alt).

    An image whose figure has a box on its page is shown as a ``figure`` with a file, any other as a ``description``. Its own
    description counts before that of the figure; '' if there is none. Ids may begin with ``fig:``. Of figures that share an id
    one with a box counts, then the last description. Null markup has no image. The markup is in the vocabulary, where values
    stand in double quotes without angle brackets.
    """
    found = images(pages).withColumnRenamed("alt", "_own")
    both = found.join(_known(figures, suffix), ["doc_id", "page_index", "fig_id"], "left")
    alt = F.when(F.col("_own") != "", F.col("_own")).otherwise(F.coalesce("alt", F.lit("")))
    return both.select("doc_id", "page_index", "nth", "tag", "fig_id", F.when(F.col("file").isNotNull(), "figure").otherwise("description").alias("shown_as"), "file", alt.alias("alt"))


def _shown(image: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(image["tag"], r'(?i)\s(?:src|alt)="[^"]*"', ""), r"(?i)^<img|\s*/?>$", "")
    placed = F.concat(F.lit('<img src="figures/'), image["file"], F.lit('" alt="'), text.escaped(image["alt"]), F.lit('"'), rest, F.lit(">"))
    said = F.concat(F.lit('<p class="figure-description"><strong>Image: </strong>'), F.when(image["alt"] == "", "(no description)").otherwise(text.escaped(image["alt"])), F.lit("</p>"))
    return F.when(image["file"].isNotNull(), placed).otherwise(said)


def resolve(pages: DataFrame, figures: DataFrame, suffix: str = ".png") -> DataFrame:
    """pages with their images resolved in ``html``: shown from their files, or described in words; all other columns as they were.

    Images are taken out, looked up and put back between the parts of the markup that they stood between. Pages without any
    are untouched. Rows that share doc_id and page_index must not differ in their markup.
    """
    listed = lookup(pages, figures, suffix).select("doc_id", "page_index", "nth", _shown(F.struct("tag", "file", "alt")).alias("shown")).distinct()
    listed = listed.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("nth", "shown"))).alias("_images"))
    listed = listed.select(F.col("doc_id").alias("_of_doc"), F.col("page_index").alias("_of_page"), "_images")
    whole = pages.join(listed, (pages["doc_id"].cast("string") == F.col("_of_doc")) & (pages["page_index"].cast("int") == F.col("_of_page")), "left")
    parts = F.split(pages["html"], IMAGE)
    spliced = F.concat(parts[0], F.array_join(F.transform("_images", lambda x, i: F.concat(x["shown"], F.get(parts, i + 1))), ""))
    return whole.select(*[F.when(F.col("_images").isNull(), pages[c]).otherwise(spliced).alias(c) if c == "html" else pages[c] for c in pages.columns])
