"""Edits whose history and output do not fit one frame or the driver."""

import random

from pagewright.plans import stream_queries
from pagewright.streaming import edits


def test_output_of_streams_is_in_files(spark, data):
    for query in (stream_queries.stream_conflicts, stream_queries.stream_latest):
        out = query(spark, data)
        assert out.inputFiles() and out.count() > 0


def test_outcomes_frame_by_frame(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice([None, 0, 1, 2, 5])) for i in range(200)]
    expected = {}
    for page in {(d, p) for _, d, p, _ in rows}:
        own = [(i, b) for i, d, p, b in rows if (d, p) == page]
        expected |= dict(zip([i for i, _ in own], edits.decide([b for _, b in own], 0)[0], strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = edits.outcomes(spark.createDataFrame(rng.sample(rows, 200), "event_id long, doc_id string, page_index int, base_version int"))
        assert {r["event_id"]: (r["version"], r["outcome"]) for r in found.collect()} == expected
        # A group's frame would hold the whole history of a page.
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
