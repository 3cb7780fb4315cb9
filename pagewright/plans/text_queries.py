"""Queries on texts: scalar rules over documents and over literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry, text
from pagewright.operators import outline
from pagewright.sources.adapters import PAGES_SQL, pages, table



def title_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of web pages, some as programs write them."""
    title, i = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.col("page_id") % 8
    stored = (
        F.when(i == 0, F.concat(F.lit("Microsoft Word - "), title)).when(i == 1, F.concat(title, F.lit(".DOCX"))).when(i == 2, F.replace(title, F.lit(" "), F.lit("_"))).when(i == 3, F.sha2(title.cast("binary"), 256))
        .when(i == 4, F.concat(F.lit("scanned document "), "page_id")).when(i == 5, F.concat(F.lit("  "), title, F.lit(" "))).otherwise(title)
    )
    return table(spark, sf_dir, "pages").select("page_id", text.usable_title(stored).alias("title"))


def author_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources as authors, some as accounts."""
    source, i = F.col("source"), F.col("doc_id") % 5
    stored = F.when(i == 0, F.concat(F.lit("svc_"), source)).when(i == 1, F.lit("Windows User")).when(i == 2, F.concat(F.lit("owner of "), source)).otherwise(source)
    return table(spark, sf_dir, "documents").select("doc_id", text.usable_author(stored).alias("author"))


def language_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' languages, some with regions that tags may or may not have."""
    lang, i = F.col("lang"), F.col("doc_id") % 5
    tag = F.when(i == 0, F.concat(lang, F.lit("-"), F.upper(lang))).when(i == 1, F.concat(lang, F.lit("_"), F.upper(lang))).when(i == 2, F.concat(lang, F.lit("-"), F.repeat(lang, F.lit(5)))).when(i == 3, F.repeat(lang, F.lit(2))).otherwise(lang)
    return table(spark, sf_dir, "documents").select("doc_id", text.is_language(tag).alias("ok"))


def api_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages' addresses as those of endpoints, some with the endpoint's path."""
    i = F.col("page_id") % 4
    given = F.concat(F.lit(" "), "url", F.when(i == 0, "/chat/completions").when(i == 1, "/completions//").when(i == 2, "//").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.api_root(given).alias("root"))


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as turns: some are no numbers."""
    given = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(((F.col("event_id") % 1441 - 720) / 2).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", geometry.rotation(given).alias("degrees"))


def knit_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjoining words of documents as if a page ended between them, the first with a hyphen; the word after them decides what is known."""
    ws = F.col("_ws")
    words = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("_ws"))
    few = F.greatest(F.size(ws) - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(ws, F.lit(1), few).alias("w"), F.slice(ws, F.lit(2), few).alias("lead"))
    pairs = words.select("doc_id", F.posexplode(zipped).alias("nth", "_p")).select("doc_id", "nth", "_p.w", "_p.lead")
    mark = F.when(F.col("nth") % 11 == 0, F.lit("\u00ad")).when(F.col("nth") % 11 == 1, F.lit("")).when(F.col("nth") % 2 == 0, F.lit("-")).otherwise(F.lit("‐"))
    tail = F.when(F.col("nth") % 5 == 0, F.concat("w", F.lit("-x"), mark)).otherwise(F.concat("w", mark))
    lower = lambda c: F.lower(F.col(c))
    known = F.when(F.col("nth") % 3 == 0, F.array(F.concat(lower("w"), F.lit("-"), lower("lead")))).when(F.col("nth") % 3 == 1, F.array(F.concat(lower("w"), F.lit("-"), lower("lead")), F.concat(lower("w"), lower("lead")))).otherwise(F.array(F.concat(lower("w"), F.lit("-x"), lower("lead"))))
    broken = pairs.select("doc_id", "nth", "lead", tail.alias("tail"), known.alias("known"))
    before, after = text.broken_word(F.col("tail"), F.col("lead"))
    parted = broken.withColumns({"before": before, "after": after})
    return parted.select("doc_id", "nth", text.knit(F.col("tail"), F.col("lead"), F.col("known"), (F.col("before"), F.col("after"))).alias("knit"))


def bbox_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of the documents' ids on a page of 1200 by 1600 pixels."""
    i = F.col("doc_id")
    box = F.array((i % 900).cast("double"), (i % 700).cast("double"), (i % 900 + i % 37).cast("double"), (i % 700 + i % 251).cast("double"))
    boxed = table(spark, sf_dir, "documents").select("doc_id", box.alias("box"))
    return boxed.select("doc_id", geometry.is_box(F.col("box")).alias("valid"), geometry.crop(F.col("box"), F.lit(1200), F.lit(1600)).alias("c")).select("doc_id", "valid", "c.*")


def clamp_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", geometry.scaled((i % 700 - 20).cast("double"), F.lit(612.0)).alias("x"), geometry.render_scale((i % 300 + 400).cast("double"), F.lit(600.0)).alias("scale"))


def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies; every tenth begins with a refusal, in capitals."""
    reply = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("I CANNOT REPRODUCE this. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_refusal(reply).alias("refused"))


def dot_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("text", F.lit(" . . . . . . "), F.col("doc_id"), F.lit("....3"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_leaders(line).alias("line"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document, lower-cased, compounds whole, with how often they stand there."""
    return outline.vocabulary(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"))


def slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.slug(title).alias("slug"))


def doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.document_id(title, F.sha2(F.col("url").cast("binary"), 256)).alias("doc_id"))


def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.page_ids(pages(spark, sf_dir))


def heading_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels made of the documents' ids, eight to a group, without skips."""
    levels = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).alias("doc_id"), (F.col("doc_id") % 8).cast("int").alias("ord"), (F.col("doc_id") * 7 % 6 + 1).cast("int").alias("level"))
    return outline.without_skips(levels)


_SLUG = r"coalesce(nullif(left(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), 80), ''), 'document')"
_TITLE = r"(SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)"

QUERIES = {
    "title_usable": (
        title_usable,
        r"""SELECT page_id, CASE WHEN regexp_matches(t, '(?i)^(microsoft\s+)?(word|excel|powerpoint|publisher|office)\s+-\s+') OR regexp_matches(t, '(?i)\.(docx?|rtf|odt|wpd|pptx?|xlsx?|pdf|txt|html?|tiff?|jpe?g|png|indd|qxd|e?ps)$')
        OR regexp_matches(t, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-|[0-9a-f]{16}') OR regexp_matches(t, '(?i)^(untitled|no title|title|none|unknown|(scanned |microsoft word )?(document|scan|image|page|presentation)) ?[0-9]*$')
        OR (contains(t, '_') AND NOT contains(t, ' ')) THEN '' ELSE t END AS title FROM (SELECT page_id, trim(CASE page_id % 8 WHEN 0 THEN 'Microsoft Word - ' || title WHEN 1 THEN title || '.DOCX'
          WHEN 2 THEN replace(title, ' ', '_') WHEN 3 THEN sha256(title) WHEN 4 THEN 'scanned document ' || CAST(page_id AS VARCHAR) WHEN 5 THEN '  ' || title || ' ' ELSE title END) AS t
          FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages))""",
    ),
    "author_usable": (
        author_usable,
        """SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^(svc|service)[-_.]|^(administrator|admin|user|owner|default|unknown|none|author|scanner|windows user|microsoft office user|registered user)$')
        THEN '' ELSE t END AS author FROM (SELECT doc_id, trim(coalesce(CASE doc_id % 5 WHEN 0 THEN 'svc_' || source WHEN 1 THEN 'Windows User' WHEN 2 THEN 'owner of ' || source ELSE source END, '')) AS t FROM documents)""",
    ),
    "language_ok": (
        language_ok,
        """SELECT doc_id, coalesce(regexp_matches(CASE doc_id % 5 WHEN 0 THEN lang || '-' || upper(lang) WHEN 1 THEN lang || '_' || upper(lang) WHEN 2 THEN lang || '-' || repeat(lang, 5)
        WHEN 3 THEN repeat(lang, 2) ELSE lang END, '^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$'), false) AS ok FROM documents""",
    ),
    "api_root": (
        api_root,
        """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(' ' || url || CASE page_id % 4 WHEN 0 THEN '/chat/completions' WHEN 1 THEN '/completions//' WHEN 2 THEN '//' ELSE '' END),
        '/+$', ''), '(/chat)?/completions$', ''), '/+$', '') AS root FROM pages""",
    ),
    "rotation": (
        rotation,
        """SELECT event_id, CAST(coalesce(((CAST(q AS INT) % 4) + 4) % 4 * 90, 0) AS INT) AS degrees FROM (SELECT event_id, round_even(CASE WHEN event_id % 7 <> 0 THEN (event_id % 1441 - 720) / 2.0::DOUBLE END / 90, 0) AS q FROM events)""",
    ),
    "knit_word": (
        knit_word,
        r"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents), p AS (SELECT doc_id, CAST(n - 1 AS INT) AS nth, ws[n] AS w, ws[n + 1] AS lead FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS n FROM a)),
        t AS (SELECT *, CASE WHEN nth % 11 = 0 THEN chr(173) WHEN nth % 11 = 1 THEN '' WHEN nth % 2 = 0 THEN '-' ELSE '‐' END AS m, CASE WHEN nth % 5 = 0 THEN w || '-x' ELSE w END AS s FROM p),
        k AS (SELECT *, regexp_extract(s || m, '(?s)^(.*)[-‐' || chr(173) || ']$', 1) AS stem, right(s || m, 1) AS mark, lower(regexp_extract(lead, '^([\p{L}\p{N}]+)', 1)) AS after, CASE nth % 3 WHEN 0 THEN [lower(w) || '-' || lower(lead)]
          WHEN 1 THEN [lower(w) || '-' || lower(lead), lower(w) || lower(lead)] ELSE [lower(w) || '-x' || lower(lead)] END AS known FROM t),
        b AS (SELECT *, lower(regexp_extract(stem, '([\p{L}\p{N}‐-]+)$', 1)) AS before FROM k)
        SELECT doc_id, nth, CASE WHEN mark NOT IN ('-', '‐', chr(173)) OR after = '' THEN NULL WHEN mark = chr(173) THEN stem
          WHEN NOT regexp_matches(lead, '^\p{Ll}') OR (NOT list_contains(known, before || after) AND (contains(before, '-') OR list_contains(known, before || '-' || after))) THEN s || m ELSE stem END AS knit FROM b""",
    ),
    "bbox_crop": (
        bbox_crop,
        """WITH b AS (SELECT doc_id, CAST(doc_id % 900 AS DOUBLE) AS x0, CAST(doc_id % 700 AS DOUBLE) AS y0, CAST(doc_id % 900 + doc_id % 37 AS DOUBLE) AS x1, CAST(doc_id % 700 + doc_id % 251 AS DOUBLE) AS y1 FROM documents),
        c AS (SELECT *, greatest(0, least(CAST(trunc(x0 / 1000 * 1200) AS INT), 1199)) AS "left", greatest(0, least(CAST(trunc(y0 / 1000 * 1600) AS INT), 1599)) AS top FROM b)
        SELECT doc_id, x0 < x1 AND y0 < y1 AS valid, "left", top, least(greatest(CAST(trunc(x1 / 1000 * 1200) AS INT), "left" + 1), 1200) AS "right",
               least(greatest(CAST(trunc(y1 / 1000 * 1600) AS INT), top + 1), 1600) AS bottom FROM c""",
    ),
    "clamp_boxes": (
        clamp_boxes,
        """SELECT doc_id, greatest(0.0::DOUBLE, least(1000.0::DOUBLE, CAST(doc_id % 700 - 20 AS DOUBLE) / 612.0::DOUBLE * 1000.0::DOUBLE)) AS x,
        1600.0::DOUBLE / greatest(CAST(doc_id % 300 + 400 AS DOUBLE), 600.0::DOUBLE) AS scale FROM documents""",
    ),
    "refusal_flag": (
        refusal_flag,
        """SELECT doc_id, doc_id % 10 = 0 AND length(text) + 25 <= 1500 OR (doc_id % 10 <> 0 AND length(trim(text)) <= 1500 AND (contains(lower(text), 'copyright') OR contains(lower(text), 'intellectual property')
        OR contains(lower(text), 'i cannot ') OR contains(lower(text), 'unable to comply'))) AS refused FROM documents""",
    ),
    "dot_leaders": (
        dot_leaders,
        r"SELECT doc_id, regexp_replace(text || ' . . . . . . ' || CAST(doc_id AS VARCHAR) || '....3', '(?:\s*[.․‥…]){5,}\s*', ' ', 'g') AS line FROM documents",
    ),
    "vocabulary": (
        vocabulary,
        r"""SELECT doc_id, count(*) AS n_words, min(word) AS first_word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-‐][\p{L}\p{N}]+)*')) AS word FROM documents) GROUP BY doc_id""",
    ),
    "slug_title": (slug_title, f"SELECT page_id, {_SLUG} AS slug FROM {_TITLE}"),
    "doc_id": (doc_id, f"SELECT page_id, regexp_replace(left({_SLUG}, 60), '-+$', '') || '-' || substr(sha256(url), 1, 8) AS doc_id FROM {_TITLE}"),
    "page_ids": (
        page_ids,
        f"""WITH RECURSIVE p AS ({PAGES_SQL}), b AS (SELECT doc_id, page_index, 'pg-' || coalesce(label, CAST(page_index AS VARCHAR)) AS name, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS n FROM p WHERE NOT skip AND trim(html) <> ''),
        r AS (SELECT doc_id, page_index, n, name AS page_id, [name] AS taken FROM b WHERE n = 1
          UNION ALL SELECT doc_id, page_index, n, page_id, list_append(taken, page_id) AS taken FROM (SELECT b.doc_id, b.page_index, b.n, r.taken,
            list_filter(list_transform(range(0, b.n), lambda k: b.name || repeat('b', k)), lambda c: NOT list_contains(r.taken, c))[1] AS page_id FROM b JOIN r ON b.doc_id = r.doc_id AND b.n = r.n + 1) x)
        SELECT doc_id, page_index, page_id FROM r""",
    ),
    "heading_clamp": (
        heading_clamp,
        """WITH RECURSIVE l AS (SELECT doc_id // 8 AS doc_id, CAST(doc_id % 8 AS INT) AS ord, CAST(doc_id * 7 % 6 + 1 AS INT) AS level FROM documents),
        r AS (SELECT doc_id, ord, level, least(level, 2) AS new_level FROM l WHERE ord = 0 UNION ALL SELECT l.doc_id, l.ord, l.level, least(l.level, r.new_level + 1) FROM l JOIN r ON l.doc_id = r.doc_id AND l.ord = r.ord + 1)
        SELECT doc_id, ord, level, CAST(new_level AS INT) AS new_level FROM r""",
    ),
}
