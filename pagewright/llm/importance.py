"""Quality by importance resampling of hashed n-grams.

Two generative models of hashed word unigrams and bigrams, one of target text and one of all text. A document's importance
weight is the ratio of its probabilities under both; the documents with the largest sums of log weight and seeded Gumbel
noise are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_sample, table, written
from pagewright.llm.shingles import mix64, word_hashes

BUCKETS = 10_000
#: Labelled documents that the target model is made of at most.
MAX_LABELLED = 20_000
#: The share of the documents that is sampled.
KEEP = 0.8
#: Added to each bucket's count in both models.
SMOOTHING = 1.0
SEED = "resample-1"
#: Keys that the search for the threshold brings to the driver at most.
FEW = 10_000


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram, and the text that it stands in."""
    words, owner = word_hashes(texts)
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    same = owner[1:] == owner[:-1]
    both = np.concatenate([words, mix64(pair[same] ^ np.uint64(1))])
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[1:][same]])


def models(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """(doc_id, text), (doc_id) -> for each bucket the log ratio of its probability in target text and in all text.

    target's rows are bounded by the caller and broadcast; every document counts towards the model of all text. The counts come
    to the driver as one row for each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                bucket, owner = _buckets(part.column(0))
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                is_target = part.column(1).to_numpy(zero_copy_only=False)
                total[1] += np.bincount(bucket[is_target[owner]], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(BUCKETS), pa.int32()), "raw": total[0], "target": total[1]})

    named = target.select(F.col("doc_id").alias("target_id")).distinct()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    flagged = texts.join(F.broadcast(named), F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("is_target"))
    sums = flagged.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = np.full((2, BUCKETS), SMOOTHING)
    for batch in sums.toArrow().to_batches():
        found[:, batch.column(0).to_numpy()] += np.array([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
    share = found / found.sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_grams, log_weight): the summed log ratios of its n-grams; 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                bucket, owner = _buckets(part.column(1))
                n = np.bincount(owner, minlength=part.num_rows)
                weight = np.bincount(owner, shared.value[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, n_grams long, log_weight double")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise that depends on seed and id alone."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, from counts in ever finer steps: the driver sees 4,096 counts a round, and FEW values in the end.

    df is read once a round, so it should be a written table.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = df.filter((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / 4096
        step = F.least(F.floor((F.col(column) - low) / width), F.lit(4095)) if width > 0 else F.lit(0)
        counts = inside.groupBy(step.cast("int").alias("step")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))
        for row in sorted(counts.collect(), reverse=True):
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["least"], row["most"]
        if low == high:
            return low
        if row["n"] <= FEW:
            rest = df.filter((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()
            return sorted((r[0] for r in rest), reverse=True)[k - above - 1]


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """(doc_id, text), (doc_id) -> (doc_id, n_grams, log_weight, key, kept), one row for each document.

    kept marks the ``keep`` share of the documents, rounded up, with the largest keys, and any that tie with the last of them.
    Null and empty texts weigh as much as average text, log weight 0. Without a target all documents do but for the smoothing.
    Rows that share an id, or have none, share the noise of that id; rows of a target id are all of the target.
    """
    weighed = log_weights(docs, models(docs, target)).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    weighed = written(weighed, "resample-keys")
    n = weighed.count()
    least = kth_largest(weighed, "key", max(1, -int(-n * keep // 1))) if n else 0.0
    return weighed.withColumn("kept", F.col("key") >= least)


def target_of(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The ids of documents labelled to be of quality, max_labelled of them at most, by hash of the id."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return bounded_sample(good, max_labelled, "doc_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), target_of(table(spark, sf_dir, "labels")))
