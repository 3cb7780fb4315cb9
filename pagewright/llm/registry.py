"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import collocations, fingerprint, importance, language_id, mixing, ngram_join, packing, quality_rules, spelling, topk, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1,
    "op2_importance": importance.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_language_id": language_id.op4,
    "op5_warc_revisits": warc.op5,
    "op6_mix_sources": mixing.op6,
    "op7_url_filter": url_filter.op7,
    "op8_toxicity": toxicity.op8,
    "op9_fingerprint": fingerprint.op9,
    "op10_pack_documents": packing.op10,
    "op11_collocations": collocations.op11,
    "op12_spelling": spelling.op12,
    "op13_top_k": topk.op13,
    "pipeline": corpus_pipeline.run,
}

#: The other queries are held against brute force or held-out labels in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op5_warc_revisits": warc.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op9_fingerprint": fingerprint.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_top_k": topk.OP13_SQL,
}
