"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so that its size follows the document's, and
similarity and containment are estimated from the kept hashes alone, however unequal two documents are. Of a short text, with
few hashes below, it keeps the least ones up to a floor instead, so that a text of few shingles is kept whole. The sketch of a
union follows from the sketches. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE, table, written

SHINGLE = 5
#: A hash is kept if its first hexadecimal digit is below this one: a quarter of them.
BELOW = "4"
HEX_DIGITS = 16
#: Where fewer distinct hashes than this are below, the least so many of all are kept.
FLOOR = 64
#: Neighbouring ids that one window orders.
BUCKET = 512


def shingle_hashes(words: Column) -> Column:
    """The distinct hashes of an array of words. Of fewer than five words the whole sequence is one shingle; none has none."""
    n = F.size(words)
    hashes = F.when(
        n >= SHINGLE,
        F.transform(
            F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(words, i - 1 + k) for k in range(SHINGLE)])), 1, HEX_DIGITS)
        ),
    ).otherwise(F.when(n > 0, F.array(F.substring(F.md5(F.array_join(words, " ")), 1, HEX_DIGITS))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(hashes)


def sketch(hashes: Column) -> Column:
    """The kept ones of distinct hashes, sorted."""
    below = F.filter(hashes, lambda h: h < BELOW)
    return F.when(F.size(below) >= FLOOR, F.array_sort(below)).otherwise(F.slice(F.array_sort(hashes), 1, FLOOR))


def _reach(kept: Column) -> Column:
    """The hash up to which a sketch has all hashes of its set; beyond any if it has the whole set."""
    last_below = chr(ord(BELOW) - 1) + "f" * (HEX_DIGITS - 1)
    return F.when(F.size(kept) < FLOOR, "g").otherwise(F.greatest(F.lit(last_below), F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))))


def _common(one: Column, other: Column) -> tuple[Column, Column]:
    """Two sketches as far as both reach."""
    reach = F.least(_reach(one), _reach(other))
    return F.filter(one, lambda h: h <= reach), F.filter(other, lambda h: h <= reach)


def likeness(one: Column, other: Column) -> Column:
    """The Jaccard similarity of the sets that two sketches stand for, from the hashes as far as both reach; 1 if both sets are empty."""
    a, b = _common(one, other)
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either > 0, shared / either).otherwise(F.lit(1.0))


def containment(one: Column, other: Column) -> Column:
    """The share of the first set that is in the second, from the hashes as far as both reach; 1 if there are none of the first."""
    a, b = _common(one, other)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def merged(one: Column, other: Column) -> Column:
    """The sketch of the union."""
    return sketch(F.array_union(one, other))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sketch of a text column; null counts as empty."""
    # The words must be a column before a lambda refers to them, else they are split again for each shingle; a
    # generator keeps the two projections apart.
    split = df.withColumn("_words", F.explode(F.array(F.array_remove(F.split(text, SPACE), ""))))
    hashed = split.withColumn("_hashes", F.explode(F.array(shingle_hashes(F.col("_words"))))).drop("_words")
    return hashed.withColumn(name, sketch(F.col("_hashes"))).drop("_hashes")


def side_by_side(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, _bucket, _guest): the rows dealt to buckets of neighbouring ids, one shuffle of the texts.

    The first row of each bucket is a guest at the end of the bucket before that has any, the very first one at the end of the
    last, so that a window over a bucket finds the next row of each of its own.
    """
    own = docs.select("doc_id", "text", F.floor(F.col("doc_id") / bucket).alias("_bucket"))
    firsts = own.groupBy("_bucket").agg(F.min(F.struct("doc_id", "text")).alias("_first"))
    before = _following(own.select("_bucket").distinct()).withColumnRenamed("_bucket", "_before")
    guests = firsts.join(before, F.col("_bucket") == F.col("_after")).select("_first.doc_id", "_first.text", F.col("_before").alias("_bucket"), F.lit(True).alias("_guest"))
    return own.withColumn("_guest", F.lit(False)).unionByName(guests).repartition("_bucket")


def with_next(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as side_by_side deals them, without the guests, each with these columns of the next in ascending doc_id and text, named next_*; after the last comes the first."""
    order = Window.partitionBy("_bucket").orderBy("_guest", "doc_id", "text")
    ahead = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter("NOT _guest").drop("_guest", "_bucket")
    return ahead.select("*", *[F.col("_next").getField(c).alias(f"next_{c}") for c in columns]).drop("_next")


def _following(buckets: DataFrame) -> DataFrame:
    """(_bucket) -> (_bucket, _after): the next bucket that has rows; after the last comes the first."""
    wide = buckets.withColumn("_wide", F.floor(F.col("_bucket") / 4096))
    inside = Window.partitionBy("_wide").orderBy("_bucket")
    ahead = wide.withColumn("_after", F.lead("_bucket").over(inside))
    # A row for each 4,096 buckets of 512 ids.
    heads = wide.groupBy("_wide").agg(F.min("_bucket").alias("_head"))
    every = Window.orderBy("_wide").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("_next_head", F.coalesce(F.lead("_head").over(Window.orderBy("_wide")), F.first("_head").over(every)))
    return ahead.join(heads.select("_wide", "_next_head"), "_wide").select("_bucket", F.coalesce("_after", "_next_head").alias("_after"))


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """A text whose last quarter, in code points and rounded down, is replaced by as many from the start of the following one, or all of it."""
    quarter = F.floor(n_chars / 4).cast("int")
    return F.concat(F.left(text, n_chars.cast("int") - quarter), F.left(following, quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A null text is empty; the fingerprint of an empty text is the empty string, and two empty ones are alike. Rows without an
    id are left out, for they have no place in the order; rows that share one follow each other in the order of their texts.
    """
    plain = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Sketches are made after the shuffle, which carries the texts alone.
    own = with_sketch(side_by_side(plain), "text", "sketch").withColumn("n_chars", F.char_length("text").cast("long"))
    paired = with_next(own, ["text", "sketch"])
    changed = paired.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text"))).drop("text", "next_text")
    both = with_sketch(changed, "edited", "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


_HASHES = """list_sort(list_distinct(
    CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: substr(md5(w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]), 1, 16))
         WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 16)] ELSE [] END))"""
_SKETCH = "CASE WHEN len(list_filter(a, lambda h: h < '4')) >= 64 THEN list_filter(a, lambda h: h < '4') ELSE a[1:64] END"
_REACH = "CASE WHEN len({0}) < 64 THEN 'g' ELSE greatest('3fffffffffffffff', {0}[len({0})]) END"


def _near_sql(other: str) -> str:
    reach = f"least({_REACH.format('sketch')}, {_REACH.format(other)})"
    return f"list_filter(sketch, lambda h: h <= {reach}) AS a_{other}, list_filter({other}, lambda h: h <= {reach}) AS b_{other}"


def _likeness_sql(other: str) -> str:
    shared = f"len(list_intersect(a_{other}, b_{other}))"
    either = f"(len(a_{other}) + len(b_{other}) - {shared})"
    return f"CASE WHEN {either} > 0 THEN CAST({shared} AS DOUBLE) / {either} ELSE 1.0 END"


OP9_SQL = f"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents WHERE doc_id IS NOT NULL),
own AS (
  SELECT doc_id, text, n_chars, {_SKETCH} AS sketch FROM (SELECT *, {_HASHES} AS a FROM (SELECT *, regexp_extract_all(text, '[^ \\t-\\r]+') AS w FROM plain))),
paired AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text,
         coalesce(lead(sketch) OVER o, first_value(sketch) OVER o) AS next_sketch
  FROM own WINDOW o AS (ORDER BY doc_id)),
changed AS (
  SELECT *, substr(text, 1, CAST(n_chars - n_chars // 4 AS BIGINT)) || substr(next_text, 1, CAST(n_chars // 4 AS BIGINT)) AS edited FROM paired),
done AS (
  SELECT *, {_SKETCH} AS edited_sketch FROM (SELECT *, {_HASHES} AS a FROM (SELECT *, regexp_extract_all(edited, '[^ \\t-\\r]+') AS w FROM changed))),
met AS (
  SELECT *, {_near_sql("edited_sketch")}, {_near_sql("next_sketch")} FROM done)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(sketch, '') AS fingerprint,
       array_to_string(edited_sketch, '') AS edited_fingerprint,
       {_likeness_sql("edited_sketch")} AS near_edited, {_likeness_sql("next_sketch")} AS near_next
FROM met
"""
