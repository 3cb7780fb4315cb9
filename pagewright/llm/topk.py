"""The highest inner products of stated queries with all vectors, by aggregation of sorted lists without random access.

The vectors are dealt into blocks and the queries to every block. In a block each component has its list, sorted by value; a
query reads it from the end that raises its score. As the lists are read, deeper by the round, a vector's score lies between
what has been read of it plus the least, and plus the most, that the unread rest of the lists can add. A query stops reading
when all but a few contenders lie below the k-th lower bound, its own or that of blocks read before, and those few are then
resolved to their scores. Whoever reads to the end has all scores. Blocks give at most k rows a query, which are ranked
once more.

All values are whole numbers, and bounds are sums of doubles that hold them exactly as long as no sum passes 2 ** 53; where
one could, scores are worked out in integers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import table

#: What a component counts, highest scores of a query, and the rows whose ids it divides are queries.
SCALE, TOLD, EVERY = 1024, 10, 100
#: Vectors that share their sorted lists, queries that read them together, and components that a task holds of either at most.
BLOCK, TOGETHER, HELD = 4096, 256, 1 << 20
#: Shares of a list that are read by the rounds, and contenders at which a query stops reading.
ROUNDS, CONTENDERS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1), 64
#: Vectors that one task takes to its queries, about.
PER_TASK = 1 << 20


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Scaled whole components, a row a list; what a shorter list lacks is 0."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


class _Lists:
    """A block of vectors as lists sorted by component, and what has been read of them at each round."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        n, width = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable")
        down = np.empty_like(order)
        np.put_along_axis(down, order, np.arange(n)[:, None], axis=0)
        ordered = np.take_along_axis(vectors, order, axis=0)
        self.ends = ordered[0], ordered[-1]
        self.rounds = []
        for share in ROUNDS:
            depth = max(1, math.ceil(n * share))
            high, low = (down < depth).astype(float), (down >= n - depth).astype(float)
            self.rounds.append((depth == n, high, low, high * vectors, low * vectors, ordered[depth - 1], ordered[n - depth]))

    def read(self, queries: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """The lower and upper bounds of all scores after a round, and whether they are the scores."""
        whole, high, low, high_values, low_values, high_front, low_front = self.rounds[number]
        up, dn = np.maximum(queries, 0), np.minimum(queries, 0)
        seen = up @ high_values.T + dn @ low_values.T
        if whole:
            return seen, seen, True
        most_up, most_dn = up * high_front, dn * low_front
        least_up, least_dn = up * self.ends[1], dn * self.ends[0]
        upper = seen + (most_up + most_dn).sum(axis=1)[:, None] - (most_up @ high.T + most_dn @ low.T)
        lower = seen + (least_up + least_dn).sum(axis=1)[:, None] - (least_up @ high.T + least_dn @ low.T)
        return lower, upper, False


class _Best:
    """The highest scores of queries so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def _add(self, query: int, scores: list, ids: list) -> None:
        """Pairs of a negative score and an id, least first, are highest scores and smaller ids first."""
        both = self.found[query] + [(-int(s), i) for s, i in zip(scores, ids, strict=True)]
        self.found[query] = sorted(both)[: self.k]

    def _least(self, query: int) -> float:
        own = self.found[query]
        return -own[-1][0] if len(own) == self.k else -math.inf

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        most = float(np.abs(self.queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        if most >= 2**52:
            self._take_large(ids, vectors)
            return
        lists = _Lists(ids, vectors)
        for lo in range(0, len(self.ids), TOGETHER):
            self._read(lists, np.arange(lo, min(lo + TOGETHER, len(self.ids))))

    def _read(self, lists: _Lists, reading: np.ndarray) -> None:
        k = self.k
        for number in range(len(ROUNDS)):
            lower, upper, whole = lists.read(self.queries[reading], number)
            own = self.ids[reading][:, None] == lists.ids
            upper = np.where(own, -np.inf, upper)
            least = np.array([self._least(q) for q in reading.tolist()])
            if len(lists.ids) > k:
                kth = np.partition(np.where(own, -np.inf, lower), len(lists.ids) - k, axis=1)[:, -k]
                least = np.maximum(least, kth)
            contends = (upper >= least[:, None]) & ~own
            stops = whole | (contends.sum(axis=1) <= CONTENDERS)
            for at in np.flatnonzero(stops).tolist():
                who = np.flatnonzero(contends[at])
                scores = lower[at, who] if whole else lists.vectors[who] @ self.queries[reading[at]]
                self._add(int(reading[at]), scores.tolist(), lists.ids[who].tolist())
            reading = reading[~stops]
            if not len(reading):
                return

    def _take_large(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Whole numbers that doubles would round: all scores as integers."""
        exact = [[int(v) for v in row] for row in vectors.tolist()]
        for query, row in enumerate(self.queries.tolist()):
            own = [int(v) for v in row]
            scores = [sum(a * b for a, b in zip(own, other, strict=True)) for other in exact]
            others = [j for j, i in enumerate(ids.tolist()) if i != self.ids[query]]
            self._add(query, [scores[j] for j in others], [int(ids[j]) for j in others])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query, id, vector), queries first -> each query's best among the vectors."""
    asked: list[pa.RecordBatch] = []
    best = None
    for batch in batches:
        is_query = batch.column(0).to_numpy(zero_copy_only=False)
        n = int(is_query.sum())
        if n:
            asked.append(batch.slice(0, n))
        others = batch.slice(n)
        at = 0
        while at < others.num_rows:
            lengths = np.diff(others.column(2).offsets.to_numpy())[at : at + BLOCK]
            width = int(lengths.max(initial=1))
            part = others.slice(at, max(1, min(BLOCK, HELD // max(1, width))))
            at += part.num_rows
            if best is None:
                if not asked:
                    return
                lists = pa.concat_arrays([b.column(2) for b in asked])
                ids = pa.concat_arrays([b.column(1) for b in asked]).to_numpy()
                best = _Best(ids, _matrix(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=1))), k)
            width = max(width, best.queries.shape[1])
            best.queries = np.pad(best.queries, ((0, 0), (0, width - best.queries.shape[1])))
            best.take(part.column(1).to_numpy(), _matrix(part.column(2), width))
    if best is not None:
        ends = np.iinfo(np.int64)
        rows = [(q, i, min(max(-s, ends.min), ends.max)) for q, found in zip(best.ids.tolist(), best.found, strict=True) for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])


def _whole(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = TOLD) -> DataFrame:
    """(vec_id, embedding) of the vectors and of the queries -> (query_id, rank, vec_id, score): of each query the ``k`` highest scores
    among the vectors with another id than its own, ties by the smaller id, all of them if there are fewer.

    A score is the inner product of the components times 1024, rounded down; components that one of two vectors lacks add
    nothing. Rows with a null id, a null vector or one with a null or non-finite component take no part. Vectors that
    repeat are ranked each; of queries that share an id the least vector asks. Other columns are not looked at. A score
    beyond a long is given as the last long. Without queries, or other vectors, there is no row.
    """
    kept = [df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & _whole(F.col("embedding"))) for df in (vectors, queries)]
    candidates, asked = kept[0], kept[1].groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = candidates.count()
    components = asked.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()[0]
    # Tasks are pairs of a part of the queries and a part of the vectors: queries that fit in a task, and vectors that keep all cores busy.
    query_parts = max(1, math.ceil(components / HELD))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vector_parts = max(1, math.ceil(n / PER_TASK), min(math.ceil(2 * cores / query_parts), math.ceil(n / 256)))
    part = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int")
    all_parts = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    to_queries = candidates.select(F.lit(False).alias("query"), "vec_id", "embedding", part("v", vector_parts).alias("_v"), all_parts(query_parts).alias("_q"))
    to_vectors = asked.select(F.lit(True).alias("query"), "vec_id", "embedding", part("q", query_parts).alias("_q"), all_parts(vector_parts).alias("_v"))
    dealt = to_queries.unionByName(to_vectors).withColumn("_task", F.col("_q") * vector_parts + F.col("_v"))
    dealt = dealt.repartitionById(query_parts * vector_parts, F.col("_task")).sortWithinPartitions(F.desc("query"))
    found = dealt.select("query", "vec_id", "embedding").mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 100 against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


#: The same as a join of the queries with all rows.
OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
