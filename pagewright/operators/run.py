"""A transcription run: pages go through a backend, and what comes back is data, refusals and failures included."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import model_json, text
from pagewright.functions.text import LONGEST_REFUSAL, REFUSALS
from pagewright.operators import state

REPLIES = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("reply", T.StringType()), T.StructField("failure", T.StringType()), T.StructField("fell_back", T.BooleanType())]
)


class Backend(Protocol):
    """Reads a page. It is made once in each task; what it raises becomes the page's failure."""

    def transcribe(self, prompt: str) -> str: ...


class EchoBackend:
    """A backend for tests: it returns the prompt's last paragraph as the page, refuses where that says so, and fails where that says so."""

    def transcribe(self, prompt: str) -> str:
        last = prompt.rsplit("\n\n", 1)[-1]
        if "REFUSE" in last:
            return "I'm sorry, but I can't reproduce this page."
        if "FAIL" in last:
            raise RuntimeError("the backend failed")
        return '{"label": "", "html": "<p>' + last.replace("\\", "").replace('"', "'").replace("\n", " ") + '</p>"}'


def replies(prompts: DataFrame, make: Callable[[], Backend], fallback: Callable[[], Backend] | None = None) -> DataFrame:
    """(doc_id, page_index, prompt) -> (doc_id, page_index, reply, failure, fell_back). A reply that refuses is asked of the fallback."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = make(), fallback() if fallback else None
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                reply = failure = None
                fell_back = False
                try:
                    reply = first.transcribe(page.prompt)
                    if second and refuses(reply):
                        fell_back, reply = True, second.transcribe(page.prompt)
                except Exception as error:  # one bad page must not end the run
                    failure = str(error)[:500]
                rows.append((page.doc_id, page.page_index, reply, failure, fell_back))
            yield pd.DataFrame(rows, columns=REPLIES.names)

    return prompts.select("doc_id", "page_index", "prompt").mapInPandas(ask, REPLIES)


def refuses(reply: str) -> bool:
    """is_refusal for one reply. It runs in tasks, so it names constants only: the module text holds functions that cannot travel."""
    bare = reply.strip().lower()
    return 0 < len(bare) <= LONGEST_REFUSAL and not bare.startswith("{") and any(p in bare for p in REFUSALS)


def transcribe(pages: DataFrame, prompts: DataFrame, make: Callable[[], Backend], actor: str, at: Column, fallback: Callable[[], Backend] | None = None) -> DataFrame:
    """The pages after a run over those that wait for one: results applied, failures and unread replies in their notes."""
    asked = prompts.join(state.to_do(pages).select(*state.KEY), [*state.KEY], "left_semi")
    came = replies(asked, make, fallback).withColumn("json", model_json.json_of(F.col("reply")))
    good = came.filter("json IS NOT NULL").select(*state.KEY, "fell_back", model_json.result_of(F.col("json")).alias("r")).select(*state.KEY, "fell_back", "r.*")
    noted = good.withColumn("notes", text.joined_notes(F.when(F.col("fell_back"), "the first model refused").otherwise(""), F.col("notes")))
    done = state.apply_results(pages, noted, actor, at)
    bad = came.filter("json IS NULL").select(*state.KEY, F.coalesce("failure", F.when(text.is_refusal(F.col("reply")), "the model refused"), F.lit("the reply is not a result")).alias("_failure"))
    failed = done.join(bad, [*state.KEY], "left")
    return failed.withColumns({"status": F.when(F.col("_failure").isNotNull(), "error").otherwise(F.col("status")), "notes": F.coalesce("_failure", "notes")}).drop("_failure")


def totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, done, errors, refused, fell_back) of a run, from the pages before and after it."""
    went = state.to_do(before).select(*state.KEY)
    return after.join(went, [*state.KEY], "left_semi").groupBy("doc_id").agg(
        F.count_if(F.col("status").isin("done", "needs_review")).alias("done"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.contains("notes", F.lit("the model refused"))).alias("refused"),
        F.count_if(F.contains("notes", F.lit("the first model refused"))).alias("fell_back"),
    )
