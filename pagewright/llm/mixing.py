"""Mixing sources to target weights by capped water-filling.

Each source's target is ``min(cap, level * weight)``, where the level is the one at which the targets add up to what the
mix shall hold: clamping sources at their cap and resharing the excess by weight, until none is above, ends at just that.
A source's documents are then taken whole ``floor(target / size)`` times, and once more for those that come first in a
seeded order, as far as the rest of the target goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import n_words, table, written

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of the seeded hash that name a bucket: 4,096 of them.
BUCKET_DIGITS = 3


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row for each source.

    Sources weigh ``weights`` in turn, by code point, null last. The table holds one row for each source, so that the
    windows over all of it see few rows. Sources without words get no target. If all sources reach their cap, the mix
    is smaller than asked for.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"),
    ).withColumn("cap", F.col("source_size") * max_epochs)
    # Sources reach their cap in the order of cap / weight; before is what lies below the level at that point.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    placed = (
        weighed.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("asked", F.sum("source_size").over(every) * total_percent)
        # The level if exactly the sources before this one are clamped; the first row where it is below the own cap holds.
        .withColumn("level", (F.col("asked") / 100.0 - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    # In the order of the window above, for of sources that reach their cap at the same level the first is the one that holds.
    first = F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level"))
    level = F.min(F.when(F.col("holds"), first)).over(every)
    return (
        placed.withColumn("reached", level.getField("level"))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("reached") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "source_size", F.greatest(F.col("target"), F.lit(0.0)).alias("target"))
    )


def _place(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    total_percent: int = TOTAL_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, text, ...) -> (doc_id, size, source_size, target, taken, copies), one row for each document.

    taken is a multiple of the document's size, and at most ``max_epochs`` times it. The words taken of a source differ
    from its target by less than one document. Empty and null texts have size 0, so that nothing is taken of them, and are
    copied as their place in the order says; a null source is a source. Documents that share an id share their place in the
    order, in which the smaller of them comes first. Reruns agree.

    The order within a source runs over buckets of the hash, whose sizes are summed first, so that no source is ever
    ordered in one task; only a (source, bucket) is.
    """
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), _place(F.col("doc_id"), seed).alias("place")
    ).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sized = written(sized, "mix-sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    aims = targets(
        buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, total_percent, max_epochs
    )
    # A window over the buckets of a source: at most 4,096 rows each.
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
        .withColumnsRenamed({"source": "of", "bucket": "in"})
        .join(aims, F.col("of").eqNullSafe(F.col("source")))
        .drop("source")
    )
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        sized.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        # In once more if its middle lies below the rest.
        .withColumn("once_more", (F.col("bucket_start") + F.col("in_bucket")) * 2 + F.col("size") < F.col("rest") * 2)
        .withColumn("copies", F.least(F.col("epochs") + F.col("once_more").cast("long"), F.lit(max_epochs).cast("long")))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    )


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns whatever these are named.

    Rows that share an id, or have none, are all taken alike. Of an empty table nothing is taken.
    """
    taken = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2 AS cap,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight
  FROM sources),
placed AS (
  SELECT *, CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS caps_before,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left,
         CAST(sum(source_size) OVER () * 150 AS BIGINT) AS asked
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (CAST(asked AS DOUBLE) / 100.0::DOUBLE - caps_before) / weight_left AS level FROM placed),
reached AS (SELECT level AS reached FROM levels WHERE level * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source LIMIT 1),
aims AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT reached FROM reached) * weight, CAST(cap AS DOUBLE))) AS target
  FROM weighed),
ordered AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(least(epochs + CASE WHEN CAST(start * 2 + size AS DOUBLE) < (target - epochs * source_size) * 2 THEN 1 ELSE 0 END, 2)
            * size AS BIGINT) AS taken
FROM ordered
"""
