"""Queries on built pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import markup, text
from pagewright.operators import assemble, figures, html_checks, outline, sanitize
from pagewright.sources.adapters import PAGES_SQL, pages, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "html")


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_checks.page_issues(_pages(spark, sf_dir))


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all findings of all pages, by severity and code."""
    return html_checks.issues(_pages(spark, sf_dir)).groupBy("severity", "code").agg(F.count("*").alias("n"))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_checks.findings(_pages(spark, sf_dir))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_checks.headings(_pages(spark, sf_dir))


def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips among headings whose levels are made of the words' lengths."""
    found = html_checks.headings(_pages(spark, sf_dir)).select("page_id", F.posexplode(F.split("text", " ")).alias("nth", "word"))
    return html_checks.skipped_levels(found.select("page_id", "nth", (F.length("word") % 6 + 1).alias("level"))).select("page_id", "nth", "level", "previous")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_checks.links(_pages(spark, sf_dir))


def broken_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made into fragments, against ids that every third link's target has."""
    p = table(spark, sf_dir, "pages")
    marked = p.select("page_id", F.concat(F.regexp_replace("html", 'href="/', 'href="#'), F.lit('<p id="The"></p><p id="and"></p>')).alias("html"))
    return html_checks.broken_fragments(marked)


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of list items' first letters, several of which fall together."""
    p = table(spark, sf_dir, "pages")
    marked = p.select("page_id", F.regexp_replace("html", r'<li><a href="/([A-Za-z])', r'<li id="$1"><a href="/$1').alias("html"))
    return html_checks.duplicate_ids(marked)


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.visible_text(F.col("html")).alias("text"))


def table_of_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Sure: <table><tr><td>"), F.col("page_id"), F.lit("</td></tr></table>"), F.when(F.col("page_id") % 2 == 0, " and <table></table> too").otherwise(" done"))
    return table(spark, sf_dir, "pages").select("page_id", text.table_of(F.when(F.col("page_id") % 5 == 0, "no").otherwise(reply)).alias("found"))


def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.escaped(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitize(_pages(spark, sf_dir))


def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", markup.text_of(markup.tokens(F.col("html"))).alias("text"))


def normalised_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("doc_id"), (F.col("doc_id") % 5).cast("int").alias("ord"), (F.col("doc_id") * 3 % 4 + 1).cast("int").alias("level"))
    return outline.normalised(found).select("doc_id", "ord", "new_level")


def chapter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    blocks = table(spark, sf_dir, "documents").select(F.floor(i / 20).alias("doc_id"), (i % 20).cast("int").alias("ord"), F.when(i % 6 == 0, "h1").when(i % 7 == 1, "h2").otherwise("p").alias("tag"))
    return outline.chapters(blocks)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble(pages(spark, sf_dir)).select("doc_id", "html", "n_pages", "n_merged")


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as the pages of documents, twenty each, in the vocabulary; a page may end in the middle of a paragraph."""
    web = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 20).cast("string").alias("doc_id"), (F.col("page_id") % 20 + 1).cast("int").alias("page_index"), F.lit(None).cast("string").alias("label"), "html",
        (F.col("page_id") % 3 == 0).alias("starts_mid_paragraph"), (F.col("page_id") % 3 == 2).alias("ends_mid_paragraph"), F.lit(False).alias("skip"),
    )
    return sanitize.sanitize(web)


def finished_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished document must have: one heading of level 1, no skips, no id twice, a mark for each page."""
    html = F.col("html")
    levels = F.transform(F.regexp_extract_all(html, F.lit(r"<h([1-6])\b"), 1), lambda x: x.cast("int"))
    ids = F.regexp_extract_all(html, F.lit(r'<[a-z][^>]*?\sid="([^"]*)"'), 1)
    skips = F.zip_with("levels", F.slice("levels", 2, F.size("levels")), lambda x, y: y > x + 1)
    found = assemble.assemble(_marked_up(spark, sf_dir)).select("doc_id", "n_pages", levels.alias("levels"), ids.alias("ids"), F.regexp_count(html, F.lit('role="doc-pagebreak"')).alias("marks"))
    return found.select(
        "doc_id", "n_pages", F.size(F.filter("levels", lambda x: x == 1)).alias("tops"), F.size(F.filter(skips, lambda x: x)).alias("skips"),
        (F.size("ids") - F.size(F.array_distinct("ids"))).alias("repeated_ids"), "marks",
    )


def epub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and sizes of the files in each document's book."""
    whole = assemble.assemble(pages(spark, sf_dir))
    return assemble.book_files(whole).select("doc_id", "name", F.length("content").alias("n_chars"))


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page under a heading of its own, with links to the page two ahead and to itself."""
    p = pages(spark, sf_dir)
    here = F.concat(F.lit('<h2 id="s-'), "page_index", F.lit('">'), "page_index", F.lit('</h2><p><a href="#s-'), F.col("page_index") + 2, F.lit('">on</a> <a href="#s-'), "page_index", F.lit('">here</a></p>'))
    return p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", here.alias("html")))).alias("_p")).select("doc_id", F.array_join(F.transform("_p", lambda x: x["html"]), "").alias("html"))


def cross_chapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents whose pages are chapters: those to another chapter name its file, those within one stay."""
    cut = assemble.relinked(assemble.chapters(_chained(spark, sf_dir)))
    return cut.select("doc_id", F.substring_index("file", "/", -1).alias("own"), F.explode(F.regexp_extract_all("body", F.lit('href="([^"]*)"'), 1)).alias("href"))


def _pictured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with two images in their markup, and the figures of every other page, the first of which has a box."""
    p = pages(spark, sf_dir)
    html = F.concat(F.lit('<p>'), F.regexp_replace("draft_text", "[&<>]", ""), F.lit('<img src="fig:a" alt=""><img alt="own" src="b"></p>'))
    known = p.filter("page_index % 2 = 0").select("doc_id", "page_index", F.explode(F.array(F.lit("fig:a"), F.lit("b"))).alias("id"), F.left(F.regexp_replace("draft_text", "[&<>\"]", ""), F.lit(20)).alias("alt"))
    return p.withColumn("html", html), known.withColumn("bbox", F.when(F.col("id") == "fig:a", F.array(*[F.lit(float(x)) for x in (1, 2, 30, 40)])))


def figure_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images in pages' markup, looked up among the figures."""
    return figures.lookup(*_pictured(spark, sf_dir)).select("doc_id", "page_index", "fig_id", "shown_as", "file", "alt")


def figure_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' markup with the images shown or described."""
    return figures.resolve(*_pictured(spark, sf_dir)).select("doc_id", "page_index", "html")


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_HEADINGS = rf"""SELECT page_id, CAST(nth - 1 AS INT) AS nth, CAST(regexp_extract(h, '(?is)<h([1-6])', 1) AS INT) AS level,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', 1), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS nth FROM (SELECT page_id, regexp_extract_all({_BARE}, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>') AS hs FROM pages))"""
_FINDINGS = rf"""SELECT page_id, severity, code FROM (SELECT page_id, {_BARE} AS b FROM pages) p, LATERAL (VALUES
  ('error', 'lang', NOT regexp_matches(b, '(?is)<html\b[^>]*\blang="[^"]*\S')), ('error', 'title', NOT regexp_matches(b, '(?is)<title\b[^>]*>\s*[^<\s]')),
  ('warning', 'h1-count', len(regexp_extract_all(b, '(?i)<h1\b')) <> 1), ('error', 'empty-heading', regexp_matches(b, '(?is)<h([1-6])\b[^>]*>(\s|<[^>]*>)*</h[1-6]')),
  ('error', 'img-alt', len(regexp_extract_all(b, '(?i)<img\b')) <> len(regexp_extract_all(b, '(?is)<img\b[^>]*\balt='))), ('info', 'img-alt-empty', regexp_matches(b, '(?is)<img\b[^>]*\balt="\s*"')),
  ('warning', 'table-th', len(regexp_extract_all(b, '(?i)<table\b')) > 0 AND len(regexp_extract_all(b, '(?i)<th\b')) = 0), ('info', 'inline-style', regexp_matches(b, '(?is)<[a-z][^>]*\sstyle=')),
  ('info', 'presentational-b', regexp_matches(b, '(?i)<b\b')), ('info', 'presentational-i', regexp_matches(b, '(?i)<i\b')), ('info', 'presentational-font', regexp_matches(b, '(?i)<font\b')),
  ('info', 'presentational-center', regexp_matches(b, '(?i)<center\b')), ('warning', 'no-pagebreaks', NOT regexp_matches(b, '(?is)role="doc-pagebreak"'))) f(severity, code, fired) WHERE fired"""
_LINKS = rf"""SELECT page_id, unnest(regexp_extract_all({_BARE}, '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1)) AS href FROM pages"""

QUERIES = {
    "issue_counts": (
        issue_counts,
        rf"""WITH h AS ({_HEADINGS}), l AS ({_LINKS}),
        f AS ({_FINDINGS} UNION ALL SELECT page_id, 'warning', 'heading-skip' FROM (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY nth) AS p FROM h) WHERE level > p + 1
          UNION ALL SELECT page_id, 'warning', 'broken-fragment' FROM l WHERE starts_with(href, '#') AND length(href) > 1)
        SELECT severity, code, count(*) AS n FROM f GROUP BY severity, code""",
    ),
    "page_issues": (page_issues, _FINDINGS),
    "page_findings": (page_findings, None),
    "headings": (headings, _HEADINGS),
    "heading_skips": (
        heading_skips,
        f"""WITH w AS (SELECT page_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS nth FROM (SELECT page_id, string_split(text, ' ') AS ws FROM ({_HEADINGS}) WHERE nth = 0)),
        v AS (SELECT page_id, nth, CAST(length(word) % 6 + 1 AS INT) AS level FROM w), p AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY nth) AS previous FROM v)
        SELECT page_id, nth, level, previous FROM p WHERE level > previous + 1""",
    ),
    "links": (links, _LINKS),
    "broken_fragments": (
        broken_fragments,
        f"SELECT page_id, '#' || substr(href, 2) AS href FROM ({_LINKS}) WHERE starts_with(href, '/') AND length(href) > 1 AND substr(href, 2) NOT IN ('The', 'and')",
    ),
    "dup_ids": (
        dup_ids,
        rf"""SELECT page_id, id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<li><a href="/([A-Za-z])', 1)) AS id FROM pages) GROUP BY page_id, id HAVING count(*) > 1""",
    ),
    "visible_text": (
        visible_text,
        rf"SELECT page_id, trim(regexp_replace(regexp_replace({_BARE}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    ),
    "table_of_reply": (
        table_of_reply,
        """SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN '<table><tr><td>' || CAST(page_id AS VARCHAR) || '</td></tr></table>' || CASE WHEN page_id % 2 = 0 THEN ' and <table></table>' ELSE '' END END AS found FROM pages""",
    ),
    "escaped_titles": (
        escaped_titles,
        r"""SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS title FROM pages""",
    ),
    "sanitize": (sanitized, None),
    "tree_text": (tree_text, None),
    "normalized_headings": (
        normalised_headings,
        """WITH RECURSIVE h AS (SELECT doc_id // 5 AS doc_id, CAST(doc_id % 5 AS INT) AS ord, CAST(doc_id * 3 % 4 + 1 AS INT) AS level FROM documents),
        t AS (SELECT doc_id, count(*) FILTER (level = 1) AS tops FROM h GROUP BY doc_id),
        m AS (SELECT h.doc_id, ord, CASE WHEN tops > 1 THEN least(level + 1, 6) ELSE level END AS level FROM h JOIN t USING (doc_id) UNION ALL SELECT doc_id, -1, 1 FROM t WHERE tops <> 1),
        l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM m),
        r AS (SELECT doc_id, ord, n, least(level, 2) AS new_level FROM l WHERE n = 1 UNION ALL SELECT l.doc_id, l.ord, l.n, least(l.level, r.new_level + 1) FROM l JOIN r ON l.doc_id = r.doc_id AND l.n = r.n + 1)
        SELECT doc_id, CAST(ord AS INT) AS ord, CAST(new_level AS INT) AS new_level FROM r""",
    ),
    "chapter_number": (
        chapter_number,
        """WITH b AS (SELECT doc_id // 20 AS doc_id, CAST(doc_id % 20 AS INT) AS ord, CASE WHEN doc_id % 6 = 0 THEN 'h1' WHEN doc_id % 7 = 1 THEN 'h2' ELSE 'p' END AS tag FROM documents)
        SELECT doc_id, ord, tag, CAST(1 + sum(CASE WHEN tag IN ('h1', 'h2') AND ord > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS chapter FROM b""",
    ),
    "assemble": (assembled, None),
    "finished_document": (
        finished_document,
        """SELECT CAST(page_id // 20 AS VARCHAR) AS doc_id, count(*) AS n_pages, CAST(1 AS INT) AS tops, CAST(0 AS INT) AS skips, CAST(0 AS INT) AS repeated_ids, CAST(count(*) AS INT) AS marks
        FROM pages GROUP BY page_id // 20""",
    ),
    "epub_files": (epub_files, None),
    "cross_chapter_links": (
        cross_chapter_links,
        f"""WITH p AS ({PAGES_SQL}), c AS (SELECT doc_id, page_index, 'ch' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS VARCHAR), 3, '0') || '.xhtml' AS own FROM p)
        SELECT c.doc_id, c.own, coalesce(d.own, '') || '#s-' || CAST(c.page_index + 2 AS VARCHAR) AS href FROM c LEFT JOIN c d ON d.doc_id = c.doc_id AND d.page_index = c.page_index + 2
        UNION ALL SELECT doc_id, own, '#s-' || CAST(page_index AS VARCHAR) FROM c""",
    ),
    "figure_lookup": (
        figure_lookup,
        f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, page_index, fig_id, CASE WHEN fig_id = 'a' AND page_index % 2 = 0 THEN 'figure' ELSE 'description' END AS shown_as,
        CASE WHEN fig_id = 'a' AND page_index % 2 = 0 THEN 'p' || lpad(CAST(page_index AS VARCHAR), 3, '0') || '-a.png' END AS file,
        CASE WHEN fig_id = 'b' THEN 'own' WHEN page_index % 2 = 0 THEN left(regexp_replace(draft_text, '[&<>"]', '', 'g'), 20) ELSE '' END AS alt FROM p, (VALUES ('a'), ('b')) f(fig_id)""",
    ),
    "figure_markup": (
        figure_markup,
        f"""WITH p AS ({PAGES_SQL}), t AS (SELECT doc_id, page_index, regexp_replace(draft_text, '[&<>]', '', 'g') AS body, left(regexp_replace(draft_text, '[&<>"]', '', 'g'), 20) AS alt,
        '<p class="figure-description"><strong>Image: </strong>' AS said FROM p)
        SELECT doc_id, page_index, '<p>' || body || CASE WHEN page_index % 2 = 0 THEN '<img src="figures/p' || lpad(CAST(page_index AS VARCHAR), 3, '0') || '-a.png" alt="' || alt || '">' ELSE said || '(no description)</p>' END
        || said || 'own</p></p>' AS html FROM t""",
    ),
}
