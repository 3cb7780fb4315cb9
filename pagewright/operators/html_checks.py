"""Accessibility checks of built pages, as Column expressions over the markup.

Scripts, styles and comments are cut before tags are looked for. On markup whose attributes hold no ``>`` the findings are
those of a tree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import markup
from pagewright.functions.text import heading_text

HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
# Tags that only make an appearance.
PRESENTATIONAL = ("b", "i", "font", "center")


def bare(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, nth, level, text), nth from 0 in the order of the page."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(bare(F.col("html")), F.lit(HEADING), 0)).alias("nth", "_heading"))
    return found.select("page_id", "nth", F.regexp_extract("_heading", HEADING, 1).cast("int").alias("level"), heading_text(F.regexp_extract("_heading", HEADING, 2)).alias("text"))


def skipped_levels(found: DataFrame) -> DataFrame:
    """Headings more than one level below the one before, as it was written."""
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("nth"))
    return found.withColumn("previous", before).filter(F.col("level") > F.col("previous") + 1)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, href) of every link."""
    found = F.regexp_extract_all(bare(F.col("html")), F.lit(r"(?is)<a\b[^>]*?\bhref=\"([^\"]*)\""), 1)
    return pages.select("page_id", F.explode(found).alias("href"))


def ids(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, id) of every element that has one."""
    found = F.regexp_extract_all(bare(F.col("html")), F.lit(r"(?is)<[a-z][^>]*?\sid=\"([^\"]*)\""), 1)
    return pages.select("page_id", F.explode(found).alias("id"))


def broken_fragments(pages: DataFrame) -> DataFrame:
    """Links to a place in their page that is not there: an anti join."""
    inner = links(pages).filter(F.startswith("href", F.lit("#")) & (F.length("href") > 1)).withColumn("id", F.substring("href", 2, 1_000_000))
    return inner.join(ids(pages), ["page_id", "id"], "left_anti").select("page_id", "href")


def duplicate_ids(pages: DataFrame) -> DataFrame:
    return ids(pages).groupBy("page_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def page_issues(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, severity, code): the checks that a page answers by itself, in one pass over the markup."""
    html = F.col("_bare")
    has = lambda pattern: F.rlike(html, F.lit(pattern))
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    checks: list[tuple[Column, str, str]] = [
        (~has(r"(?is)<html\b[^>]*\blang=\"[^\"]*\S"), "error", "lang"),
        (~has(r"(?is)<title\b[^>]*>\s*[^<\s]"), "error", "title"),
        (count(r"(?i)<h1\b") != 1, "warning", "h1-count"),
        (has(r"(?is)<h([1-6])\b[^>]*>(\s|<[^>]*>)*</h[1-6]"), "error", "empty-heading"),
        (count(r"(?i)<img\b") != count(r"(?is)<img\b[^>]*\balt="), "error", "img-alt"),
        (has(r"(?is)<img\b[^>]*\balt=\"\s*\""), "info", "img-alt-empty"),
        (has(r"(?is)<table\b(?:(?!<th\b|</table).)*</table"), "warning", "table-th"),
        (has(r"(?is)<[a-z][^>]*\sstyle="), "info", "inline-style"),
        *[(has(rf"(?i)<{tag}\b"), "info", f"presentational-{tag}") for tag in PRESENTATIONAL],
        (~has(r"(?is)role=\"doc-pagebreak\""), "warning", "no-pagebreaks"),
    ]
    fired = [F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for test, severity, code in checks]
    found = pages.select("page_id", bare(F.col("html")).alias("_bare")).select("page_id", F.explode(F.array_compact(F.array(*fired))).alias("_issue"))
    return found.select("page_id", "_issue.severity", "_issue.code")


def issues(pages: DataFrame) -> DataFrame:
    """All findings of the pages (page_id, severity, code)."""
    parts = [
        page_issues(pages),
        skipped_levels(headings(pages)).select("page_id", F.lit("warning").alias("severity"), F.lit("heading-skip").alias("code")),
        broken_fragments(pages).select("page_id", F.lit("warning").alias("severity"), F.lit("broken-fragment").alias("code")),
        duplicate_ids(pages).select("page_id", F.lit("error").alias("severity"), F.lit("dup-id").alias("code")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _issue(severity: str, code: str, message: Column | str, location: Column | None = None) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), said.alias("message"), F.coalesce(location if location is not None else F.lit(""), F.lit("")).alias("location"))


def findings(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> (page_id, severity, code, message, location): each finding at each element.

    A page is parsed once into its elements, and all that is asked is answered from that array, so that nothing is shuffled.
    Null or empty markup is a page without anything, lacking a language, a title, a first heading and page breaks. Of header
    cells without a scope a table tells the first, of inline styles a page the first. Rows that share a page_id are pages of
    their own.
    """
    all_ = F.col("_elements")
    heading_tags = [f"h{n}" for n in range(1, 7)]
    parsed = pages.select("page_id", markup.elements(F.col("html")).alias("_elements"))
    read = parsed.select(
        "page_id",
        "_elements",
        F.filter(all_, lambda x: x["tag"].isin(*heading_tags)).alias("_headings"),
        F.filter(F.transform(all_, lambda x: x["attrs"]["id"]), lambda i: i != "").alias("_ids"),
    )
    ordered = F.array_sort("_ids")
    twice = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i + 1)))
    read = read.withColumn("_twice", twice)

    def each(array: Column, test: Callable[[Column], Column], issue: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(array, test), issue)

    def of(tag: str) -> Column:
        return F.filter(all_, lambda x: x["tag"] == tag)

    def once(test: Column, issue: Column) -> Column:
        return F.when(test, F.array(issue)).otherwise(F.array())

    level = lambda h: F.substring(h["tag"], 2, 1).cast("int")
    value = lambda x, name: F.coalesce(x["attrs"][name], F.lit(""))
    source = lambda x: F.when(F.startswith(value(x, "src"), F.lit("data:")), F.concat(F.lit("embedded image"), F.when(value(x, "id") != "", F.concat(F.lit(" ("), value(x, "id"), F.lit(")"))).otherwise(""))).otherwise(value(x, "src"))
    heads, ids = F.col("_headings"), F.col("_ids")
    tops = F.size(F.filter(heads, lambda h: h["tag"] == "h1"))
    before = lambda i: level(F.get(heads, i - 1))
    skips = F.filter(
        F.transform(heads, lambda h, i: F.when(level(h) > before(i) + 1, _issue("warning", "heading-skip", F.concat(F.lit("heading of level "), level(h), F.lit(" after one of level "), before(i)), h["text"]))),
        lambda x: x.isNotNull(),
    )
    styled = F.filter(all_, lambda x: value(x, "style") != "")
    checks = [
        once(~F.exists(of("html"), lambda x: F.trim(value(x, "lang")) != ""), _issue("error", "lang", "the page states no language")),
        once(F.coalesce(F.get(of("title"), F.lit(0))["blank"], F.lit(True)), _issue("error", "title", "the page has no title")),
        once(tops != 1, _issue("warning", "h1-count", F.concat(F.lit("headings of level 1: "), tops))),
        skips,
        each(heads, lambda h: h["blank"], lambda h: _issue("error", "empty-heading", F.concat(F.lit("heading without text: "), h["tag"]))),
        each(of("img"), lambda x: x["attrs"]["alt"].isNull(), lambda x: _issue("error", "img-alt", "image without alternative text", source(x))),
        each(of("img"), lambda x: F.trim(x["attrs"]["alt"]) == "", lambda x: _issue("info", "img-alt-empty", "image marked as decoration", source(x))),
        each(of("table"), lambda x: x["headers"] == 0, lambda x: _issue("warning", "table-th", "table without header cells", x["text"])),
        each(of("table"), lambda x: x["unscoped"].isNotNull(), lambda x: _issue("info", "th-scope", "header cell without a scope", x["unscoped"])),
        each(of("a"), lambda x: x["blank"] & (value(x, "aria-label") == "") & (x["images"] == 0), lambda x: _issue("error", "link-text", "link without text", value(x, "href"))),
        each(of("a"), lambda x: F.startswith(value(x, "href"), F.lit("#")) & ~F.array_contains(ids, F.regexp_replace(value(x, "href"), "^#", "")), lambda x: _issue("warning", "broken-fragment", F.concat(F.lit("no such place in the page: "), value(x, "href")))),
        F.transform("_twice", lambda i: _issue("error", "dup-id", F.concat(F.lit("id used "), F.size(F.filter(ids, lambda x: x == i)), F.lit(" times: "), i))),
        F.transform(F.slice(styled, 1, 1), lambda x: _issue("info", "inline-style", F.concat(F.lit("style in "), x["tag"]))),
        *[once(F.size(of(tag)) > 0, _issue("info", "presentational", f"appearance only: {tag}")) for tag in PRESENTATIONAL],
        once(~F.exists(all_, lambda x: value(x, "role") == "doc-pagebreak"), _issue("warning", "no-pagebreaks", "no marks of page breaks")),
    ]
    return read.select("page_id", F.explode(F.concat(*checks)).alias("_issue")).select("page_id", "_issue.*")
