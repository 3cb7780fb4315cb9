"""Page states: summaries, selections, results, edits, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("doc_id", "page_index")

# Characters of the pages before and after that a prompt and a review show.
PROMPT_TAIL, PROMPT_HEAD = 400, 250
REVIEW_TAIL, REVIEW_HEAD = 300, 200
#: Pending pages that a status lists.
LISTED = 20


def in_order() -> WindowSpec:
    """The pages of each document, in order."""
    return Window.partitionBy("doc_id").orderBy("page_index")


def summary(pages: DataFrame) -> DataFrame:
    """A row for each document: how many pages are in each state, and the text that a rollup shows."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pending", "done", "needs_review", "error")}
    out = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), *[c.alias(s) for s, c in n.items()])
    return out.withColumn("rollup", F.format_string("%d/%d approved · %d review", "done", "page_count", "needs_review"))


def pending(pages: DataFrame, listed: int = LISTED) -> DataFrame:
    """The first pending pages of each document, as many as a status lists, in order."""
    waiting = pages.filter(F.col("status") == "pending").groupBy("doc_id").agg(F.collect_list("page_index").alias("all"))
    return waiting.select("doc_id", F.slice(F.sort_array("all"), 1, listed).alias("pending"))


def neighbours(pages: DataFrame, tail: int = PROMPT_TAIL, head: int = PROMPT_HEAD) -> DataFrame:
    """The end of the page before and the start of the page after; '' where there is none."""
    draft = F.coalesce("draft_text", F.lit(""))
    return pages.select(
        *KEY,
        F.coalesce(F.right(F.lag(draft).over(in_order()), F.lit(tail)), F.lit("")).alias("previous_tail"),
        F.coalesce(F.left(F.lead(draft).over(in_order()), F.lit(head)), F.lit("")).alias("next_head"),
    )


def with_neighbours(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """The chosen pages (doc_id, page_index) and those next to them, each once, as far as they exist."""
    around = chosen.select("doc_id", F.explode(F.array(*[F.col("page_index") + k for k in (-1, 0, 1)])).alias("page_index")).distinct()
    return around.join(pages.select(*KEY), [*KEY], "left_semi")


def to_do(pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages that a run works on: pending ones and those that failed, or all."""
    return pages if force else pages.filter(F.col("status").isin("pending", "error"))


def page_numbers(spec: str, count: int) -> list[int]:
    """The pages of a range such as ``all``, ``3``, ``1-5``, ``-4``, ``9-`` or a list of them, each once, within 1 to count."""
    found: set[int] = set()
    for part in spec.replace(" ", "").split(","):
        if part in ("", "all"):
            found |= set(range(1, count + 1)) if part else set()
            continue
        first, dash, last = part.partition("-")
        if dash:
            found |= set(range(int(first or 1), int(last or count) + 1))
        else:
            found.add(int(first))
    return sorted(n for n in found if 1 <= n <= count)


def in_range(pages: DataFrame, spec: str) -> DataFrame:
    """The pages of each document that a range names; open ends are the document's own."""
    asked = F.lit(False)
    for part in spec.replace(" ", "").split(","):
        first, dash, last = part.partition("-")
        if part == "all":
            asked = F.lit(True)
        elif dash:
            asked = asked | ((F.col("page_index") >= int(first or 1)) & (F.col("page_index") <= int(last) if last else F.col("page_index") >= int(first or 1)))
        elif part:
            asked = asked | (F.col("page_index") == int(first))
    return pages.filter(asked)


def status_after(html: Column, skip: Column, notes: Column) -> Column:
    """The state that a result leaves a page in."""
    empty = (F.trim(F.coalesce(html, F.lit(""))) == "") & ~skip
    return F.when(empty | (F.trim(F.coalesce(notes, F.lit(""))) != ""), "needs_review").otherwise("done")


def apply_results(pages: DataFrame, results: DataFrame, actor: str, at: Column) -> DataFrame:
    """Pages with the results that came in for them: content replaced, version raised; an empty label keeps the old one."""
    new = results.select(*KEY, F.struct("label", "skip", "starts_mid_paragraph", "ends_mid_paragraph", "html", "notes").alias("_new"))
    joined = pages.join(new, [*KEY], "left")
    r, hit = F.col("_new"), F.col("_new").isNotNull()
    blank = (F.trim(F.coalesce(r["html"], F.lit(""))) == "") & ~F.coalesce(r["skip"], F.lit(False))
    notes = F.concat_ws(" | ", F.nullif(r["notes"], F.lit("")), F.when(blank, F.lit("the result is empty")))
    changed = {
        "label": F.coalesce(F.nullif(r["label"], F.lit("")), F.col("label")),
        "skip": r["skip"],
        "starts_mid_paragraph": r["starts_mid_paragraph"],
        "ends_mid_paragraph": r["ends_mid_paragraph"],
        "html": r["html"],
        "notes": notes,
        "status": status_after(r["html"], F.coalesce(r["skip"], F.lit(False)), notes),
        "version": F.col("version") + 1,
        "changed_by": F.lit(actor),
        "updated_at": at,
    }
    return joined.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in pages.columns])


def bulk(pages: DataFrame, chosen: Column, action: str) -> DataFrame:
    """skip, unskip, approve or needs_review for the chosen pages; content stays, the version is raised.

    Taking part again, an empty page is pending; skipping keeps the state.
    """
    empty = F.trim(F.coalesce("html", F.lit(""))) == ""
    status = {
        "skip": F.col("status"),
        "unskip": F.when(empty, "pending").otherwise(F.col("status")),
        "approve": F.when(empty & ~F.col("skip"), "pending").otherwise("done"),
        "needs_review": F.when(empty & ~F.col("skip"), "pending").otherwise("needs_review"),
    }[action]
    skip = {"skip": F.lit(True), "unskip": F.lit(False)}.get(action, F.col("skip"))
    return pages.withColumns(
        {
            "status": F.when(chosen, status).otherwise(F.col("status")),
            "skip": F.when(chosen, skip).otherwise(F.col("skip")),
            "version": F.col("version") + chosen.cast("int"),
        }
    )


def merge_import(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported pages over stored ones: the version is one above both copies'."""
    old = stored.select(*KEY, F.col("version").alias("_old"))
    merged = imported.join(old, [*KEY], "left")
    version = F.greatest(F.coalesce("version", F.lit(0)), F.coalesce("_old", F.lit(0))) + 1
    return merged.withColumn("version", F.when(F.col("_old").isNotNull(), version).otherwise(F.coalesce("version", F.lit(0)))).drop("_old")


def current(events: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ("version", "event_id")) -> DataFrame:
    """The latest event of each key: one aggregation, no sort."""
    rest = [c for c in events.columns if c not in key]
    latest = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return latest.select(*key, "_last.*")


def match_project(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """For each incoming file the stored document: that with its fingerprint, else one of its name that has no fingerprint."""
    by_print = documents.filter("fingerprint is not null").select(F.col("fingerprint"), F.col("doc_id").alias("_by_print"))
    by_name = documents.filter("fingerprint is null").select(F.col("name"), F.col("doc_id").alias("_by_name"))
    found = incoming.join(by_print, "fingerprint", "left").join(by_name, "name", "left")
    return found.select("incoming_id", F.coalesce("_by_print", "_by_name").alias("doc_id"))


def evicted(caches: DataFrame, keep: str | None, limit: int) -> DataFrame:
    """Cached documents to drop: the oldest first, until what is left fits; ``keep`` counts but is never dropped.

    One row for each document on one machine's cache, so that the window over all of them is small.
    """
    total = caches.agg(F.sum("bytes").alias("total"))
    others = caches.filter(F.col("doc_id") != F.lit(keep)) if keep is not None else caches
    older = Window.orderBy("newest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("bytes").over(older), F.lit(0))
    return others.withColumn("_gone", gone).join(total).filter(F.col("total") - F.col("_gone") > limit).select("doc_id")


def usage_totals(pages: DataFrame) -> DataFrame:
    """Tokens that a run used, by document."""
    return pages.groupBy("doc_id").agg(
        *[F.sum(F.coalesce(F.col("usage")[k], F.lit(0))).alias(k) for k in ("input_tokens", "output_tokens")], F.count_if(F.col("status") == "error").alias("errors")
    )
