import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.schema import DOCUMENTS
from pagewright.sources import files, projects

IDS = ["a", "", ".", "..", "x/y", "Ä ö%", "_saves", "a" * 150]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, project string")


def content(spark, path, **options):
    return {r["doc_id"]: r["project"] for r in projects.load(spark, path, **options).collect()}


def test_saved_is_read(spark, tmp_path):
    path = str(tmp_path / "work")
    assert content(spark, path) == {}
    projects.save(table(spark, [(i, f"one {i}") for i in IDS]), path)
    assert content(spark, path) == {i: f"one {i}" for i in IDS}
    projects.save(table(spark, [("a", "two"), ("new", "\n")]), path)
    assert content(spark, path, tasks=3) == {i: f"one {i}" for i in IDS} | {"a": "two", "new": "\n"}
    assert content(spark, "file://" + path, doc_id="a") == {"a": "two"}
    assert content(spark, path, doc_id="missing") == {}
    projects.save(table(spark, []), path)
    assert len(content(spark, path)) == len(IDS) + 1
    projects.save(table(spark, [("only", "x")]), path, replace=True)
    assert content(spark, path) == {"only": "x"}


def test_a_save_that_fails_leaves_no_half(spark, tmp_path):
    path = str(tmp_path)
    projects.save(table(spark, [("a", "old"), ("b", "old")]), path)

    bad = table(spark, [(c, "new") for c in "abcdefgh"]).withColumn("project", F.when(F.col("doc_id") == "h", F.raise_error(F.lit("lost"))).otherwise(F.col("project")))
    for rows in (bad, table(spark, [("a", "new"), ("c", None)]), table(spark, [("b", "new"), ("b", "newer")]), table(spark, [("b", "new"), (None, "x")])):
        with pytest.raises(Exception):
            projects.save(rows, path)
        assert content(spark, path) == {"a": "old", "b": "old"}


def test_files_of_lost_attempts_do_not_count(tmp_path):
    """A task that ran twice: the driver names the attempt that it takes."""
    writer = projects._Writer(str(tmp_path), False)
    first, second = writer.write([{"doc_id": "a", "project": "lost"}]), writer.write([{"doc_id": "a", "project": "kept"}])
    reader = projects._Reader(str(tmp_path), None, 4)
    assert [r for part in reader.partitions() for r in reader.read(part)] == []
    writer.commit([second, None])
    planned = reader.partitions()
    assert [r for part in planned for r in reader.read(part)] == [("a", "kept")]
    writer.commit([first])
    # What was planned before reads the state of that moment.
    assert [r for part in planned for r in reader.read(part)] == [("a", "kept")]
    assert [r for part in reader.partitions() for r in reader.read(part)] == [("a", "lost")]


def test_list_of_projects(spark, tmp_path):
    docs = spark.createDataFrame([("d", "T", "/x.pdf")], "doc_id string, title string, source string")
    own = spark.createDataFrame([("d", 2, "done"), ("d", 1, "pending")], "doc_id string, page_index int, status string")
    projects.save(files.export_projects(docs, own).unionByName(table(spark, [("bad", "{")])), str(tmp_path))
    told = {r["doc_id"]: (r["title"], r["source"], r["n_pages"], r["n_done"]) for r in projects.documents(projects.load(spark, str(tmp_path))).collect()}
    assert told == {"d": ("T", "/x.pdf", 2, 1), "bad": (None, None, None, None)}


def test_opening(spark):
    found = spark.createDataFrame(
        [("Moved", "/new/a.pdf", "f" * 16, ["i", ""], "", None, None, "Meta", "M"), ("Moved", "/z.pdf", "f" * 16, ["i", ""], "Other", None, None, None, None),
         ("My Book", "/b.pdf", "b" * 16, [None], None, "Me", None, None, None), ("Third", "/c.pdf", "c" * 16, [None, "ii"], None, None, None, "untitled", "admin")],
        "name string, source string, fingerprint string, page_labels array<string>, title string, author string, language string, meta_title string, meta_author string",
    )
    stored = spark.createDataFrame([("old-1", "/a.pdf", "A", "", "fr", "f" * 16, None), ("my-book", "/gone.pdf", "B", "x", "en", "", None), ("third", "/c.pdf", "C", "x", "en", "9" * 16, None)], DOCUMENTS)
    docs, pages = projects.opened(found, stored, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(tuple(r)[:6] for r in docs.collect()) == [
        ("my-book", "/b.pdf", "B", "Me", "en", "b" * 16),
        ("old-1", "/new/a.pdf", "A", "", "fr", "f" * 16),
        ("third-cccccccc", "/c.pdf", "Third", "", "en", "c" * 16),
    ]
    assert sorted(tuple(r) for r in pages.collect()) == [("third-cccccccc", 1, None, "pending", 0), ("third-cccccccc", 2, "ii", "pending", 0)]
    assert projects.opened(found.limit(0), stored, F.current_timestamp())[0].count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The source travels with the job: a session whose Python workers cannot import the package saves and reads."""
    script = f"""
import sys, os
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from pagewright.sources import projects
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
projects.save(spark.createDataFrame([("a", "x")], "doc_id string, project string"), {str(tmp_path / "w")!r})
print("FOUND", projects.load(spark, {str(tmp_path / "w")!r}).collect())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=120)
    assert "FOUND [Row(doc_id='a', project='x')]" in done.stdout, done.stderr[-2000:]
