import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import digest, slug
from pagewright.operators import exports, run, state
from pagewright.sources.adapters import pages


def test_markers_and_settings(spark):
    df = spark.createDataFrame([('<p>a <span id="pg-2" role="doc-pagebreak" aria-label="2"></span>b</p><div id="x" role="doc-pagebreak"></div>', {"html_pages": "false", "odd": "1"}), ("x", None)], "html string, s map<string,string>")
    rows = df.select(exports.without_markers(F.col("html")).alias("h"), exports.settings(F.col("s")).alias("s")).collect()
    assert rows[0]["h"] == "<p>a b</p>"
    assert rows[0]["s"] == exports.DEFAULTS | {"html_pages": "false"} and rows[1]["s"] == exports.DEFAULTS


def test_contents(spark):
    rows = [("d", i, level, f"T{i}", f"h-{i}") for i, level in enumerate([1, 2, 2, 3, 1, 4, 2])]
    toc = exports.contents(spark.createDataFrame(rows, "doc_id string, ord int, new_level int, text string, id string")).first()["toc"]
    for tag in ("ol", "li"):
        assert toc.count(f"<{tag}>") == toc.count(f"</{tag}>")
    assert toc.startswith('<ol><li><a href="#h-0">T0</a><ol><li><a href="#h-1">T1</a></li><li><a href="#h-2">T2</a><ol><li>') and "T5" not in toc


def test_embed(spark):
    docs = spark.createDataFrame([("d", '<img src="figures/a.png"><img src="figures/b.png">'), ("e", "x")], "doc_id string, html string")
    figures = spark.createDataFrame([("d", "a.png", bytearray(b"A"), "image/png")], "doc_id string, name string, content binary, mime string")
    got = {r["doc_id"]: r["html"] for r in exports.embed(docs, figures).collect()}
    assert got == {"d": '<img src="data:image/png;base64,QQ=="><img src="figures/b.png">', "e": "x"}


def test_checker(spark):
    report = '{"messages": [{"ID": "A", "severity": "FATAL", "message": "m", "locations": [{"path": "p", "line": 3}, {"path": "q"}]}, {"ID": "B", "severity": "USAGE", "message": "n", "locations": []}]}'
    got = sorted(tuple(r) for r in exports.checker_issues(spark.createDataFrame([("d", report)], "doc_id string, report string")).collect())
    assert got == [("d", "error", "A", "m", "p:3"), ("d", "info", "B", "n", "")]


def test_prompts(spark):
    defaults = spark.createDataFrame([("a", "one\n"), ("b", "two\n"), ("c", "three\n")], "name string, text string")
    based = defaults.select(digest(F.col("text")).alias("d"), "name")
    known = {r["name"]: r["d"] for r in based.collect()}
    edits = spark.createDataFrame([("a", "mine\r\n\n", known["a"]), ("b", "own", "older"), ("c", "  ", known["c"])], "name string, text string, based_on string")
    got = {r["name"]: tuple(r)[1:] for r in exports.prompts(defaults, edits).collect()}
    assert got == {"a": ("mine\n", True, False), "b": ("own\n", True, True), "c": ("three\n", False, False)}


def test_updated(spark):
    docs = spark.createDataFrame([("d", "T", "A", "en"), ("e", "U", "B", "de")], "doc_id string, title string, author string, language string")
    new = spark.createDataFrame([("d", " ", "C", "x")], "doc_id string, title string, author string, language string")
    assert sorted(tuple(r) for r in exports.updated(docs, new).collect()) == [("d", "T", "C", "en"), ("e", "U", "B", "de")]


@pytest.mark.parametrize("fallback", [None, run.EchoBackend])
def test_run(spark, data, fallback):
    # A text function that has been used holds what cannot travel; a run must not take it along.
    assert spark.range(1).select(slug(F.lit("Ä b"))).first()[0] == "a-b"
    own = pages(spark, data).filter("doc_id < '3'").withColumns({"changed_by": F.lit(""), "updated_at": F.lit(None).cast("timestamp")})
    body = F.when(F.col("page_index") == 2, "REFUSE").when(F.col("page_index") == 3, "FAIL").otherwise(F.concat(F.lit("page "), "page_index"))
    prompts = own.select("doc_id", "page_index", F.concat(F.lit("Read this."), F.lit("\n\n"), body).alias("prompt"))
    after = run.transcribe(own, prompts, run.EchoBackend, "echo", F.lit(None).cast("timestamp"), fallback)
    before = {(r["doc_id"], r["page_index"]): r for r in own.collect()}
    rows = {(r["doc_id"], r["page_index"]): r for r in after.collect()}
    assert rows.keys() == before.keys()
    for key, r in rows.items():
        asked = before[key]["status"] in ("pending", "error")
        if not asked:
            assert (r["status"], r["version"], r["html"]) == (before[key]["status"], before[key]["version"], before[key]["html"])
        elif key[1] in (2, 3):
            assert r["status"] == "error" and r["version"] == before[key]["version"] and r["notes"] == ("the model refused" if key[1] == 2 else "the backend failed")
        else:
            assert (r["status"], r["html"], r["version"]) == ("done", f"<p>page {key[1]}</p>", before[key]["version"] + 1)
    n = run.totals(own, after).agg(F.sum("done"), F.sum("errors"), F.sum("refused")).first()
    asked = [k for k, r in before.items() if r["status"] in ("pending", "error")]
    assert n[0] + n[1] == len(asked) and n[2] == sum(k[1] == 2 for k in asked)
    assert state.to_do(after).count() == n[1]
