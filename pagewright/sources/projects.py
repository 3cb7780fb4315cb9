"""Projects as a data source: each document with its pages as one JSON text, saved whole or not at all.

A folder of projects holds, in 256 buckets, a folder for each document with a file for each time that it was saved, and in
``_saves`` a mark for each save that was completed. A file counts once the mark of its save names the attempt that wrote it: a
task that fails, runs twice or is lost leaves files that nothing reads, and all documents of a save appear at one moment. Readers
take the marks that are there when their query is planned, so that a query sees one state although others save meanwhile.

Ids may be any text of up to 200 bytes in quoted form. Folders are reached through pyarrow's file systems, on every executor.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pagewright.functions import text
from pagewright.schema import DOCUMENTS

NAME = "pagewright_projects"
COLUMNS = "doc_id string, project string"
SAVES = "_saves"
BUCKETS = 256


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    found, inside = fs.FileSystem.from_uri(path)
    return found, inside.rstrip("/")


def _names(store, folder: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _bucket(doc_id: str) -> str:
    return f"b{zlib.crc32(doc_id.encode()) % BUCKETS:02x}"


def _folder(doc_id: str) -> str:
    return "d" + quote(doc_id, safe="")


def _put(store, path: str, content: str) -> None:
    """A file that is there whole or not at all."""
    staged = f"{path}.part"
    with store.open_output_stream(staged) as out:
        out.write(content.encode())
    store.move(staged, path)


def _saved(store, root: str, until: str) -> dict[str, int]:
    """Attempts that were completed by the mark ``until``, with the place of their save; a save that replaces all ends those before it."""
    ranks: dict[str, int] = {}
    for place, name in enumerate(n for n in _names(store, f"{root}/{SAVES}") if n.endswith(".json") and n <= until):
        with store.open_input_stream(f"{root}/{SAVES}/{name}") as mark:
            said = json.loads(mark.read())
        if said["replaces"]:
            ranks.clear()
        ranks.update(dict.fromkeys(said["attempts"], place))
    return ranks


@dataclass
class _Part(InputPartition):
    """Buckets for a task, or one document's folder in one."""

    buckets: list[str]
    only: str | None
    until: str


class _Reader(DataSourceReader):
    def __init__(self, root: str, only: str | None, tasks: int) -> None:
        self.root, self.only, self.tasks = root, only, tasks

    def partitions(self) -> list[_Part]:
        """Buckets dealt over the tasks: the driver lists at most 256 of them, and never documents."""
        store, root = _store(self.root)
        marks = [n for n in _names(store, f"{root}/{SAVES}") if n.endswith(".json")]
        until = marks[-1] if marks else ""
        if self.only is not None:
            return [_Part([_bucket(self.only)], _folder(self.only), until)]
        buckets = [n for n in _names(store, root) if n.startswith("b")]
        return [_Part(buckets[i :: self.tasks], None, until) for i in range(min(self.tasks, len(buckets)))] or [_Part([], None, until)]

    def read(self, part: _Part) -> Iterator[tuple[str, str]]:
        store, root = _store(self.root)
        ranks = _saved(store, root, part.until)
        for bucket in part.buckets:
            for folder in [part.only] if part.only else _names(store, f"{root}/{bucket}"):
                place = f"{root}/{bucket}/{folder}"
                counted = [a for a in (n.removesuffix(".json") for n in _names(store, place)) if a in ranks]
                if counted:
                    with store.open_input_stream(f"{place}/{max(counted, key=lambda a: (ranks[a], a))}.json") as project:
                        yield unquote(folder[1:]), project.read().decode()


@dataclass
class _Attempt(WriterCommitMessage):
    attempt: str


class _Writer(DataSourceWriter):
    def __init__(self, root: str, replaces: bool) -> None:
        self.root, self.replaces = root, replaces

    def write(self, rows: Iterator) -> _Attempt:
        store, root = _store(self.root)
        attempt, last = uuid.uuid4().hex, None
        for row in rows:
            if row["doc_id"] is None or row["project"] is None:
                raise ValueError("a project needs an id and a content")
            if row["doc_id"] == last:
                raise ValueError(f"two projects of one id: {last}")
            last = row["doc_id"]
            place = f"{root}/{_bucket(last)}/{_folder(last)}"
            store.create_dir(place, recursive=True)
            _put(store, f"{place}/{attempt}.json", row["project"])
        return _Attempt(attempt)

    def commit(self, messages: list[_Attempt | None]) -> None:
        """One mark makes the whole save count; it has a name for each task."""
        store, root = _store(self.root)
        store.create_dir(f"{root}/{SAVES}", recursive=True)
        said = {"replaces": self.replaces, "attempts": [m.attempt for m in messages if m]}
        _put(store, f"{root}/{SAVES}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(said))

    def abort(self, messages: list[_Attempt | None]) -> None:
        """Nothing to take back: without a mark nothing counts."""


class Projects(DataSource):
    """Options: ``path``; for reading ``doc_id`` (one document only) and ``tasks`` (at most so many; 32)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("doc_id"), int(self.options.get("tasks", 32)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def save(projects: DataFrame, path: str, replace: bool = False) -> None:
    """(doc_id, project) saved over the documents of the same id; with ``replace`` only these are left. All count, or none.

    An id that comes twice, and a null id or project, stop the save.
    """
    projects.sparkSession.dataSource.register(Projects)
    dealt = projects.select("doc_id", "project").repartition("doc_id").sortWithinPartitions("doc_id")
    dealt.write.format(NAME).mode("overwrite" if replace else "append").save(path)


def load(spark: SparkSession, path: str, doc_id: str | None = None, tasks: int = 32) -> DataFrame:
    """(doc_id, project) of all documents, or of one whose folder alone is read; no rows where nothing has been saved."""
    spark.dataSource.register(Projects)
    reader = spark.read.format(NAME).option("tasks", tasks)
    return (reader if doc_id is None else reader.option("doc_id", doc_id)).load(path)


def documents(projects: DataFrame) -> DataFrame:
    """What each project says of its document, with the number of its pages and of those done, for a list of projects.

    A project that cannot be read has its id and nulls.
    """
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in DOCUMENTS if f.name != "doc_id")
    read = projects.select("doc_id", F.from_json("project", f"STRUCT<{fields}, pages: ARRAY<STRUCT<status: STRING>>>").alias("_p"))
    told = [F.col(f"_p.{f.name}").alias(f.name) for f in DOCUMENTS if f.name != "doc_id"]
    pages = F.col("_p.pages")
    done = F.size(F.filter(pages, lambda p: p["status"] == "done"))
    return read.select("doc_id", *told, F.when(pages.isNotNull(), F.size(pages)).alias("n_pages"), F.when(pages.isNotNull(), done).alias("n_done"))


def opened(found: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Originals that a person opens -> (their documents as they are now, the pages of those that are new).

    ``found``: name (without ending), source, fingerprint, page_labels (one entry a page, null where a page has none), and the
    title, author and language that the person gave or null, meta_title and meta_author of the file. ``stored``: DOCUMENTS. A stored document
    with the fingerprint, or without any and of the file's name, is opened again: it follows the file to its new place and takes
    a title or author that was given. Any other file makes a document. Of files with one fingerprint the least source counts. Stored documents without a
    fingerprint whose original is still at its place are for the caller to leave out.
    """
    one = found.groupBy("fingerprint").agg(F.min_by(F.struct(*[c for c in found.columns if c != "fingerprint"]), "source").alias("_f")).select("fingerprint", "_f.*")
    old = stored.select(F.struct(*[F.col(f"`{f.name}`") for f in DOCUMENTS]).alias("_old"))
    known = old.filter(F.coalesce(F.col("_old.fingerprint"), F.lit("")) != "")
    by_print = known.groupBy(F.col("_old.fingerprint").alias("fingerprint")).agg(F.min_by("_old", "_old.doc_id").alias("_by_print"))
    by_name = old.filter(F.coalesce(F.col("_old.fingerprint"), F.lit("")) == "").select(F.col("_old.doc_id").alias("_slug"), F.col("_old").alias("_by_name")).dropDuplicates(["_slug"])
    met = one.withColumn("_slug", text.slug(F.col("name"))).join(by_print, "fingerprint", "left").join(by_name, "_slug", "left").withColumn("_old", F.coalesce("_by_print", "_by_name"))
    given = lambda c: F.when(F.trim(c) != "", c)
    again, title, author = F.col("_old").isNotNull(), given(F.col("title")), given(F.col("author"))
    new_title, new_author = F.coalesce(title, F.nullif(text.usable_title(F.col("meta_title")), F.lit("")), F.col("name")), F.coalesce(author, text.usable_author(F.col("meta_author")), F.lit(""))
    docs = met.select(
        F.coalesce("_old.doc_id", text.document_id(F.col("name"), F.col("fingerprint"))).alias("doc_id"), "source", F.when(again, F.coalesce(title, "_old.title")).otherwise(new_title).alias("title"),
        F.when(again, F.coalesce(author, "_old.author")).otherwise(new_author).alias("author"), F.when(again, F.col("_old.language")).otherwise(F.coalesce("language", F.lit("en"))).alias("language"),
        "fingerprint", now.alias("opened_at"), again.alias("_again"), "page_labels",
    )
    fresh = docs.filter(~F.col("_again")).select("doc_id", F.posexplode("page_labels").alias("_at", "label"))
    pages = fresh.select("doc_id", (F.col("_at") + 1).alias("page_index"), given(F.col("label")).alias("label"), F.lit("pending").alias("status"), F.lit(0).alias("version"))
    return docs.drop("_again", "page_labels"), pages
