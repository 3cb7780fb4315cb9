"""What several operators share: the shared folder, word rules, folds."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """The number of words of a text, as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0)).cast("int")


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The rows of df, or where they are more than ``most``, those whose keys hash below the share that makes it so many.

    No row is ordered or collected. The share is six standard deviations below ``most``, so that it is a bound as long as no
    key stands for many rows. Rows with equal keys are in or out together.
    """
    n = df.count()
    if n <= most:
        return df
    share = max(0.0, most - 6 * math.sqrt(most)) / n
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 40)) < int(share * (1 << 40)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
