"""Edits as a stream: the latest state of each page, accepted and stale edits, progress, throughput."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("event_id", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("outcome", T.StringType())])
_STATE = T.StructType([T.StructField("version", T.IntegerType())])


def read_edits(spark: SparkSession, path: str, schema: T.StructType, files_each: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; uploads land in such folders too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def decide(bases: list[int | None], version: int) -> tuple[list[tuple[int, str]], int]:
    """(version after, outcome) of edits in order: one based on another version than the current is a conflict and changes nothing; one without a base is taken."""
    out = []
    for base in bases:
        if base is None or base == version:
            version += 1
            out.append((version, "accepted"))
        else:
            out.append((version, "conflict"))
    return out, version


def outcomes(edits: DataFrame) -> DataFrame:
    """(event_id, doc_id, page_index, base_version) -> the same with version and outcome, for streams and tables.

    The state of a page is its version; edits of one page in a batch are taken in the order of their ids.
    """

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("event_id", ignore_index=True)
        bases = [None if pd.isna(b) else int(b) for b in frame["base_version"]]
        found, version = decide(bases, state.get[0] if state.exists else 0)
        state.update((version,))
        yield pd.DataFrame({"doc_id": key[0], "page_index": key[1], "event_id": frame["event_id"], "version": [v for v, _ in found], "outcome": [o for _, o in found]})

    if edits.isStreaming:
        return edits.groupBy("doc_id", "page_index").applyInPandasWithState(settle, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, version = None, 0
        for frame in frames:
            found = []
            for doc_id, index, base in zip(frame["doc_id"], frame["page_index"], frame["base_version"], strict=True):
                own = (None if pd.isna(doc_id) else doc_id, None if pd.isna(index) else int(index))
                if own != page:
                    page, version = own, 0
                outcome, version = decide([None if pd.isna(base) else int(base)], version)
                found += outcome
            yield frame[["doc_id", "page_index", "event_id"]].assign(version=[v for v, _ in found], outcome=[o for _, o in found])

    # Rows of a page follow each other in one partition, so that a task holds a frame and a version, however long the page's history.
    lined_up = edits.select("doc_id", "page_index", "event_id", "base_version").repartition("doc_id", "page_index")
    return lined_up.sortWithinPartitions("doc_id", "page_index", F.asc_nulls_last("event_id")).mapInPandas(whole, _OUT)


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key so far: an aggregation whose state is one row a key."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, "_last.*")


def throughput(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events a window and kind; what is later than the watermark is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, taken through it to the end, as Parquet files beside its checkpoint: no row goes through the driver."""
    rows = f"{checkpoint}-rows"

    def keep(batch: DataFrame, n: int) -> None:
        # A batch that is run again takes its own place; in complete mode each holds all rows.
        batch.write.mode("overwrite").parquet(rows if mode == "complete" else f"{rows}/batch-{n}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(rows if mode == "complete" else f"{rows}/none")
    query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows if mode == "complete" else f"{rows}/*")
