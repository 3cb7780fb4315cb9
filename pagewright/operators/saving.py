"""Edits of whole pages, saved only onto the version that they were made from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.sanitize import sanitize
from pagewright.operators.state import KEY
from pagewright.streaming.edits import decide

#: What an edit carries besides its page, its number and the version that it was made from.
CONTENT = ("label", "skip", "starts_mid_paragraph", "ends_mid_paragraph", "html", "notes", "status", "actor", "at")
# States that an editor may set.
SETTABLE = ("done", "needs_review", "pending")


def settle(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, page_index, version) and (event_id, doc_id, page_index, base_version) -> the edits with the version after them and their outcome.

    In the order of their numbers, an edit that was made from the current version, or says none, is ``accepted`` and raises it;
    one made from another is a ``conflict`` and tells the version that it met. An edit of a page that is not there, or of
    none, is ``no page``. A page's edits are folded row by row in one task, which holds a version however many there are.
    """
    now = pages.groupBy(*KEY).agg(F.max("version").cast("int").alias("_now"))
    met = edits.select("event_id", *KEY, F.col("base_version").cast("int").alias("base_version")).join(now, [*KEY], "left")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, version = None, 0
        for frame in frames:
            found = []
            for doc_id, index, base, first in zip(frame["doc_id"], frame["page_index"], frame["base_version"], frame["_now"], strict=True):
                if (doc_id, index) != page:
                    page, version = (doc_id, index), int(first)
                outcome, version = decide([None if pd.isna(base) else int(base)], version)
                found += outcome
            yield frame[["event_id", "doc_id", "page_index"]].assign(version=[v for v, _ in found], outcome=[o for _, o in found])

    there = met.filter(F.col("_now").isNotNull()).repartition(*KEY).sortWithinPartitions(*KEY, F.asc_nulls_last("event_id"))
    shape = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("event_id", *KEY)) + ", version int, outcome string"
    lost = met.filter(F.col("_now").isNull()).select("event_id", *KEY, F.col("_now").alias("version"), F.lit("no page").alias("outcome"))
    return there.mapInPandas(fold, shape).unionByName(lost)


def conflicts(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that met another version than they were made from: (doc_id, page_index, event_id, base_version, version)."""
    stale = settle(pages, edits).filter("outcome = 'conflict'").drop("outcome")
    return stale.join(edits.select("event_id", *KEY, "base_version"), ["event_id", *KEY]).select(*KEY, "event_id", "base_version", "version")


def save(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """The pages as their accepted edits leave them; event numbers must be unique.

    An edit replaces a page's markup, brought into the vocabulary, its flags, notes and state, and stamps who changed it
    and when. A null or empty label keeps the one before, null figures keep theirs. The state is the one that the edit sets, if an editor may set it,
    else it follows from the content: a page without text is to be reviewed unless it is skipped. One that is set
    is pending while there is neither text nor a skip. Columns that an edit does not have are as they were.
    """
    has_figures = "figures" in edits.columns and "figures" in pages.columns
    taken = settle(pages, edits).filter("outcome = 'accepted'").join(edits.drop("base_version", "version", "outcome"), ["event_id", *KEY])
    named = F.when(F.coalesce("label", F.lit("")) != "", F.col("event_id"))
    last = taken.groupBy(*KEY).agg(
        F.max_by(F.struct(*CONTENT), "event_id").alias("_new"), F.max("version").alias("_version"), F.max_by("label", named).alias("_label"),
        *([F.max_by("figures", F.when(F.col("figures").isNotNull(), F.col("event_id"))).alias("_figures")] if has_figures else []),
    )
    clean = sanitize(last.withColumn("_html", F.coalesce("_new.html", F.lit(""))), "_html")
    both = pages.join(clean, [*KEY], "left")
    new, hit = F.col("_new"), F.col("_new").isNotNull()
    skip = F.coalesce(new["skip"], F.lit(False))
    empty = (F.trim("_html") == "") & ~skip
    notes = F.concat_ws(" | ", F.nullif(F.trim(new["notes"]), F.lit("")), F.when(empty, F.lit("the result is empty")))
    follows = F.when(empty | (notes != ""), "needs_review").otherwise("done")
    changed = {
        "label": F.coalesce("_label", "label"),
        "skip": skip,
        "starts_mid_paragraph": F.coalesce(new["starts_mid_paragraph"], F.lit(False)),
        "ends_mid_paragraph": F.coalesce(new["ends_mid_paragraph"], F.lit(False)),
        "html": F.col("_html"),
        "notes": notes,
        "status": F.when(new["status"].isin(*SETTABLE), F.when(empty, "pending").otherwise(new["status"])).otherwise(follows),
        "version": F.col("_version"),
        "changed_by": new["actor"],
        "updated_at": new["at"],
        **({"figures": F.coalesce("_figures", "figures")} if has_figures else {}),
    }
    return both.select(*[F.when(hit, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in pages.columns])
