"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. All but the last
return the columns of docs, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import language_id, mixing, ngram_join, packing, toxicity
from pagewright.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found go: those with a null or empty text, or one without letters, among them. Repeated rows are judged each."""
    return language_id.keep_identified(docs, language_id.default_vocabulary())


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go. A null text counts as an empty one; repeated rows are judged each, and without labels none goes."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays. Rows without an id or without words all stay, and so do rows that repeat the id that stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; rows that share an id, or have none, are taken alike, and a null source is one of its own."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences that they are in. A null text is empty, a row that repeats is a document of its own."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("ngram_join", remove_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers take part: tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
