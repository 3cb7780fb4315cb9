"""Queries on pages and their states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry, model_json, text
from pagewright.operators import align, coverage, state
from pagewright.sources.adapters import PAGES_SQL, page_events, pages, table

RANGE = "2,4-5,7-"


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.summary(pages(spark, sf_dir))


def pending_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending(pages(spark, sf_dir), 2).select("doc_id", F.posexplode("pending").alias("nth", "page_index"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.neighbours(pages(spark, sf_dir))


def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.neighbours(pages(spark, sf_dir), state.REVIEW_TAIL, state.REVIEW_HEAD)


def neighbour_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    return state.with_neighbours(state.to_do(own), own)


def work_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.to_do(pages(spark, sf_dir)).select("doc_id", "page_index", "status")


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.in_range(pages(spark, sf_dir), RANGE).select("doc_id", "page_index")


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return pages(spark, sf_dir).select("doc_id", "page_index", text.n_tokens(html).alias("words"), F.contains(html, F.lit("<img")).alias("has_figures"), F.contains(html, F.lit("<table")).alias("has_tables"))


def page_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with work left, and the next one for each."""
    work = pages(spark, sf_dir).filter((F.col("status") != "done") | (F.col("page_index") == 1))
    return work.select("doc_id", "page_index", F.lead("page_index").over(state.in_order()).alias("next_index"))


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a reader sees first: the first that needs review, else the first."""
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("status") == "needs_review", F.col("page_index"))), F.min("page_index")).alias("page_index"))


def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(pages(spark, sf_dir))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.usage_totals(pages(spark, sf_dir))


def bulk_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.bulk(pages(spark, sf_dir), F.col("page_index").isin(1, 3, 5), "approve").select("doc_id", "page_index", "status", "skip", "version")


def apply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other page gets its draft as its result, an empty one where the draft is long."""
    own = pages(spark, sf_dir).withColumns({"changed_by": F.lit("before"), "updated_at": F.lit(None).cast("timestamp")})
    draft = F.col("draft_text")
    new = own.filter(F.col("page_index") % 2 == 0).select(
        "doc_id", "page_index", F.lit("").alias("label"), F.lit(False).alias("skip"), F.lit(False).alias("starts_mid_paragraph"), F.lit(True).alias("ends_mid_paragraph"),
        F.when(F.length(draft) > 600, "").otherwise(F.concat(F.lit("<p>"), draft, F.lit("</p>"))).alias("html"), F.lit("").alias("notes"),
    )
    done = state.apply_results(own, new, "model", F.lit(None).cast("timestamp"))
    return done.select("doc_id", "page_index", "label", "status", "notes", "version", "changed_by")


def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = pages(spark, sf_dir)
    imported = stored.filter("page_index <= 4").withColumn("version", (F.col("version") + F.col("page_index") * 2) % 7)
    both = state.merge_import(stored.filter("page_index <> 2"), imported)
    return both.select("doc_id", "page_index", F.col("version").cast("int").alias("version"))


def project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored with a fingerprint or, every other one, without; every third incoming file has the stored name, the others another."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("print-"), F.col("doc_id"))).alias("fingerprint")
    )
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "doc-").otherwise("other-"), F.col("doc_id"))
    incoming = docs.select(F.col("doc_id").alias("incoming_id"), name.alias("name"), F.concat(F.lit("print-"), F.col("doc_id")).alias("fingerprint"))
    return state.match_project(stored, incoming)


def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources as cached documents, their texts' size and last id as size and age; a third of the whole may stay."""
    caches = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.sum("n_chars").alias("bytes"), F.max("doc_id").alias("newest"))
    total = caches.agg(F.sum("bytes")).first()[0] or 0
    return state.evicted(caches, "src0", total // 3)


def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current(page_events(spark, sf_dir), ("doc_id",), ("ts", "event_id")).select("doc_id", "event_id", "event_type", "value")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished, failed and other events of each page, and when the last came."""
    kind = F.col("event_type")
    return page_events(spark, sf_dir).groupBy("doc_id").agg(
        F.count_if(kind == "purchase").alias("completed"), F.count_if(kind == "error").alias("errors"), F.count("*").alias("requested"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last")
    )


def model_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the results in replies: the events' JSON, some in code fences, some in prose, as results."""
    e = table(spark, sf_dir, "events")
    body = F.concat(
        F.lit('{"label": " '), F.col("user_id") % 5, F.lit('", "skip": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"),
        F.lit(', "html": "<p>'), F.col("event_type"), F.lit(' ........ 7</p>", "figures": [{"id": "fig:a", "bbox": [1, 2, 3, '), F.when(F.col("event_id") % 3 == 0, '"x"').otherwise("4"), F.lit(']}]}'),
    )
    reply = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    r = model_json.result_of(model_json.json_of(reply))
    figure = F.col("r.figures")[0]
    return e.select("event_id", r.alias("r")).select("event_id", "r.label", "r.skip", "r.ends_mid_paragraph", "r.html", figure["id"].alias("figure_id"), figure["bbox"].isNotNull().alias("has_box"), "r.notes")


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each page, as a digest and a length."""
    own = pages(spark, sf_dir)
    n = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = own.select("doc_id", "page_index", "draft_text").join(state.neighbours(own), ["doc_id", "page_index"]).join(n, "doc_id")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Document "), "doc_id", F.lit(", page "), "page_index", F.lit(" of "), "n", F.lit(".")),
        F.when(F.col("previous_tail") != "", F.concat(F.lit("The page before ends: "), "previous_tail")),
        F.when(F.col("next_head") != "", F.concat(F.lit("The page after begins: "), "next_head")),
        F.when(F.trim("draft_text") != "", F.concat(F.lit("Draft: "), "draft_text")).otherwise("There is no draft."),
        F.lit("Return one JSON object."),
    )
    return whole.select("doc_id", "page_index", F.length(prompt).cast("long").alias("prompt_chars"), text.digest(prompt).alias("prompt_digest"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page in a grid of ten columns."""
    split = F.split(F.trim(F.regexp_replace("draft_text", r"[ \t\n]+", " ")), " ")
    found = pages(spark, sf_dir).select("doc_id", "page_index", F.posexplode(split).alias("pos", "text"))
    x, y = (F.col("pos") % 10 * 100).cast("double"), (F.floor(F.col("pos") / 10) % 50 * 20).cast("double")
    return found.select("doc_id", "page_index", "pos", "text", x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 15).alias("y1"))


_WORDS_SQL = r"""
  SELECT doc_id, page_index, CAST(pos AS INT) AS pos, text, CAST(pos % 10 * 100 AS DOUBLE) AS x0, CAST(pos // 10 % 50 * 20 AS DOUBLE) AS y0,
         CAST(pos % 10 * 100 + 90 AS DOUBLE) AS x1, CAST(pos // 10 % 50 * 20 + 15 AS DOUBLE) AS y1
  FROM (SELECT doc_id, page_index, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS pos
        FROM (SELECT doc_id, page_index, string_split(trim(regexp_replace(draft_text, '[ \t\n]+', ' ', 'g')), ' ') AS words FROM pages_))"""


def words_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _words(spark, sf_dir).filter(geometry.in_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), (120.0, 15.0, 520.0, 60.0)))
    listed = inside.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("w"))
    return listed.select("doc_id", "page_index", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def locate_caret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words from the middle of each page, the third at the caret and its last letter lost, found again."""
    words = _words(spark, sf_dir)
    middle = words.groupBy("doc_id", "page_index").agg(F.floor(F.max("pos") / 2).cast("int").alias("mid"))
    near = words.join(middle, ["doc_id", "page_index"]).withColumn("j", F.col("pos") - F.col("mid") + 2).filter("j BETWEEN 0 AND 4")
    damaged = F.when((F.col("j") == 2) & (F.length("text") > 5), F.substr(F.col("text"), F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    query = F.concat_ws("-", "doc_id", "page_index")
    return align.locate(words, near.select(query.alias("query_id"), "doc_id", "page_index", "j", damaged.alias("word"), F.lit(2).alias("caret")))


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's draft against itself with a word dropped, one damaged and one put in."""
    split = F.split(F.trim(F.regexp_replace("draft_text", r"\s+", " ")), " ")
    typed = F.filter(
        F.transform(F.col("scan"), lambda w, i: F.when(i == 3, F.lit("")).when(i == 6, F.concat(w, F.lit("x"))).when(i == 9, F.concat(w, F.lit(" inserted"))).otherwise(w)), lambda w: w != ""
    )
    own = pages(spark, sf_dir).select("doc_id", "page_index", split.alias("scan"))
    return align.word_diff(own.withColumn("typed", F.flatten(F.transform(typed, lambda w: F.split(w, " ")))))


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages(spark, sf_dir).select("doc_id", "page_index", F.posexplode(F.split("draft_text", "\n")).alias("line", "text"))
    boxed = lines.filter(F.trim("text") != "").withColumns({"x0": F.lit(0.0), "y0": (F.col("line") * 20).cast("double"), "x1": F.lit(1000.0), "y1": (F.col("line") * 20 + 15).cast("double")})
    out = align.line_words(boxed)
    return out.select("doc_id", "page_index", "line", "word_no", "word", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a window of six hours and kind: review throughput in event time."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


_WITH = f"WITH pages_ AS ({PAGES_SQL})"
_EVENTS = "SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, ts, event_type, value FROM events"

QUERIES = {
    "status_summary": (
        status_summary,
        f"""{_WITH} SELECT doc_id, count(*) AS page_count, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done,
        count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'error') AS error,
        CAST(count(*) FILTER (status = 'done') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' approved · ' || CAST(count(*) FILTER (status = 'needs_review') AS VARCHAR) || ' review' AS rollup
        FROM pages_ GROUP BY doc_id""",
    ),
    "pending_first_n": (
        pending_first_n,
        f"""{_WITH} SELECT doc_id, CAST(nth - 1 AS INT) AS nth, page_index FROM
        (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS nth FROM pages_ WHERE status = 'pending') WHERE nth <= 2""",
    ),
    **{
        name: (
            f,
            f"""{_WITH} SELECT doc_id, page_index, coalesce(right(lag(draft_text) OVER o, {a}), '') AS previous_tail, coalesce(left(lead(draft_text) OVER o, {b}), '') AS next_head
            FROM pages_ WINDOW o AS (PARTITION BY doc_id ORDER BY page_index)""",
        )
        for name, f, a, b in (("neighbour_context", neighbour_context, 400, 250), ("review_context", review_context, 300, 200))
    },
    "neighbour_closure": (
        neighbour_closure,
        f"""{_WITH} SELECT doc_id, page_index FROM pages_ p WHERE EXISTS
        (SELECT 1 FROM pages_ q WHERE q.doc_id = p.doc_id AND abs(q.page_index - p.page_index) <= 1 AND q.status IN ('pending', 'error'))""",
    ),
    "work_selection": (work_selection, f"{_WITH} SELECT doc_id, page_index, status FROM pages_ WHERE status IN ('pending', 'error')"),
    "page_range": (page_range, f"{_WITH} SELECT doc_id, page_index FROM pages_ WHERE page_index = 2 OR page_index BETWEEN 4 AND 5 OR page_index >= 7"),
    "page_list": (
        page_list,
        rf"{_WITH} SELECT doc_id, page_index, CAST(len(regexp_extract_all(html, '\S+')) AS BIGINT) AS words, contains(html, '<img') AS has_figures, contains(html, '<table') AS has_tables FROM pages_",
    ),
    "page_filters": (
        page_filters,
        f"{_WITH} SELECT doc_id, page_index, lead(page_index) OVER (PARTITION BY doc_id ORDER BY page_index) AS next_index FROM pages_ WHERE status <> 'done' OR page_index = 1",
    ),
    "first_page": (first_page, f"{_WITH} SELECT doc_id, coalesce(min(page_index) FILTER (status = 'needs_review'), min(page_index)) AS page_index FROM pages_ GROUP BY doc_id"),
    "coverage_flags": (
        coverage_flags,
        rf"""{_WITH}, m AS (SELECT *, len(regexp_extract_all(draft_text, '[\p{{L}}\p{{N}}_]+')) AS dw, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')) AS hw FROM pages_),
        f AS (SELECT *, CASE WHEN status = 'pending' THEN 'error untranscribed' WHEN status = 'error' THEN 'error page-error'
          WHEN skip THEN CASE WHEN dw > 30 THEN 'warning skipped-with-text' END
          WHEN dw >= 30 AND CAST(hw AS DOUBLE) / dw < 0.6::DOUBLE THEN 'warning under-coverage' WHEN dw >= 30 AND CAST(hw AS DOUBLE) / dw > 1.6::DOUBLE THEN 'warning over-coverage' END AS first FROM m)
        SELECT doc_id, page_index, split_part(first, ' ', 1) AS severity, split_part(first, ' ', 2) AS code, 'page ' || CAST(page_index AS VARCHAR) AS location FROM f WHERE first IS NOT NULL
        UNION ALL SELECT doc_id, page_index, 'info', 'model-note', 'page ' || CAST(page_index AS VARCHAR) FROM f WHERE status = 'needs_review' AND NOT skip AND notes <> ''""",
    ),
    "usage_totals": (
        usage_totals,
        f"{_WITH} SELECT doc_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) FILTER (status = 'error') AS errors FROM pages_ GROUP BY doc_id",
    ),
    "bulk_action": (
        bulk_action,
        f"""{_WITH} SELECT doc_id, page_index, CASE WHEN page_index IN (1, 3, 5) THEN CASE WHEN html = '' AND NOT skip THEN 'pending' ELSE 'done' END ELSE status END AS status, skip,
        CAST(version + CASE WHEN page_index IN (1, 3, 5) THEN 1 ELSE 0 END AS INT) AS version FROM pages_""",
    ),
    "apply_results": (
        apply_results,
        f"""{_WITH} SELECT doc_id, page_index, label, CASE WHEN page_index % 2 <> 0 THEN status WHEN length(draft_text) > 600 THEN 'needs_review' ELSE 'done' END AS status,
        CASE WHEN page_index % 2 <> 0 THEN notes WHEN length(draft_text) > 600 THEN 'the result is empty' ELSE '' END AS notes,
        CAST(version + CASE WHEN page_index % 2 = 0 THEN 1 ELSE 0 END AS INT) AS version, CASE WHEN page_index % 2 = 0 THEN 'model' ELSE 'before' END AS changed_by FROM pages_""",
    ),
    "import_merge": (
        import_merge,
        f"""{_WITH}, i AS (SELECT doc_id, page_index, version AS old, (version + page_index * 2) % 7 AS new FROM pages_ WHERE page_index <= 4)
        SELECT doc_id, page_index, CAST(CASE WHEN page_index <> 2 THEN greatest(old, new) + 1 ELSE new END AS INT) AS version FROM i""",
    ),
    "project_match": (
        project_match,
        "SELECT doc_id AS incoming_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS doc_id FROM documents",
    ),
    "cache_eviction": (
        cache_eviction,
        """WITH c AS (SELECT source AS doc_id, sum(n_chars) AS bytes, max(doc_id) AS newest FROM documents GROUP BY source), t AS (SELECT sum(bytes) AS total FROM c),
        o AS (SELECT doc_id, coalesce(sum(bytes) OVER (ORDER BY newest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c WHERE doc_id <> 'src0')
        SELECT doc_id FROM o, t WHERE total - gone > total // 3""",
    ),
    "latest_page": (
        latest_page,
        f"SELECT doc_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS n FROM ({_EVENTS})) WHERE n = 1",
    ),
    "job_progress": (
        job_progress,
        f"""SELECT doc_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS errors, count(*) AS requested, min(last) AS last
        FROM (SELECT *, first_value(event_type) OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS last FROM ({_EVENTS})) GROUP BY doc_id""",
    ),
    "model_result": (
        model_result,
        """SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS label, event_id % 2 = 0 AS skip, false AS ends_mid_paragraph, '<p>' || event_type || ' 7</p>' AS html,
        'a' AS figure_id, event_id % 3 <> 0 AS has_box, '' AS notes FROM events""",
    ),
    "prompt_assembly": (
        prompt_assembly,
        f"""{_WITH}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(right(lag(draft_text) OVER o, 400), '') AS tail, coalesce(left(lead(draft_text) OVER o, 250), '') AS head
          FROM pages_ WINDOW o AS (PARTITION BY doc_id ORDER BY page_index)),
        p AS (SELECT doc_id, page_index, concat_ws(chr(10) || chr(10), 'Document ' || doc_id || ', page ' || CAST(page_index AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || '.',
          CASE WHEN tail <> '' THEN 'The page before ends: ' || tail END, CASE WHEN head <> '' THEN 'The page after begins: ' || head END,
          CASE WHEN trim(draft_text) <> '' THEN 'Draft: ' || draft_text ELSE 'There is no draft.' END, 'Return one JSON object.') AS prompt FROM n)
        SELECT doc_id, page_index, CAST(length(prompt) AS BIGINT) AS prompt_chars, substr(sha256(prompt), 1, 12) AS prompt_digest FROM p""",
    ),
    "words_in_box": (
        words_in_box,
        f"""{_WITH}, w AS ({_WORDS_SQL}) SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY pos) AS text FROM w
        WHERE (x0 + x1) / 2 BETWEEN 120 AND 520 AND (y0 + y1) / 2 BETWEEN 15 AND 60 GROUP BY doc_id, page_index""",
    ),
    "locate_caret": (
        locate_caret,
        f"""{_WITH}, w AS ({_WORDS_SQL}), m AS (SELECT doc_id, page_index, max(pos) // 2 AS mid FROM w GROUP BY ALL),
        q AS (SELECT doc_id || '-' || CAST(page_index AS VARCHAR) AS query_id, doc_id, page_index, pos - mid + 2 AS j,
          regexp_replace(lower(CASE WHEN pos = mid AND length(text) > 5 THEN left(text, CAST(length(text) - 1 AS BIGINT)) ELSE text END), '[^a-z0-9]+', '', 'g') AS key
          FROM w JOIN m USING (doc_id, page_index) WHERE pos - mid + 2 BETWEEN 0 AND 4),
        k AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS wkey FROM w),
        need AS (SELECT query_id, least(3, count(*)) AS need FROM q WHERE key <> '' GROUP BY query_id),
        v AS (SELECT query_id, q.doc_id, q.page_index, k.pos - j + 2 AS pos, j FROM q JOIN k ON q.doc_id = k.doc_id AND q.page_index = k.page_index
          AND key <> '' AND wkey <> '' AND (key = wkey OR (least(length(key), length(wkey)) >= 4 AND (starts_with(key, wkey) OR starts_with(wkey, key))))),
        s AS (SELECT query_id, doc_id, page_index, pos, count(*) + 0.5::DOUBLE * max(CASE WHEN j = 2 THEN 1 ELSE 0 END) AS score FROM v GROUP BY ALL),
        r AS (SELECT query_id, w.pos, score, w.text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, w.pos) AS n FROM s JOIN w USING (doc_id, page_index, pos))
        SELECT query_id, pos, CAST(score AS DOUBLE) AS score, text FROM r JOIN need USING (query_id) WHERE n = 1 AND score >= need""",
    ),
    "word_diff": (word_diff, None),
    "line_words": (
        line_words,
        rf"""{_WITH}, l AS (SELECT doc_id, page_index, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line FROM (SELECT doc_id, page_index, string_split(draft_text, chr(10)) AS ls FROM pages_)),
        w AS (SELECT doc_id, page_index, line, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_no FROM (SELECT *, regexp_extract_all(text, '\S+') AS ws FROM l)),
        s AS (SELECT *, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id, page_index, line ORDER BY word_no) AS DOUBLE) AS upto,
          CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id, page_index, line) - 1 AS DOUBLE) AS total FROM w)
        SELECT doc_id, page_index, line, word_no, word, round((upto - length(word) - 1) * (1000.0::DOUBLE / total), 6) AS x0, round(upto * (1000.0::DOUBLE / total), 6) AS x1 FROM s""",
    ),
    "throughput": (
        throughput,
        "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
}
