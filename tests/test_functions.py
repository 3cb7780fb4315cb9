import hashlib
import time
import tracemalloc
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry, markup, model_json, text
from pagewright.plans import catalog, text_queries
from pagewright.sources import files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'binary'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


TITLES = (
    "Annual report", "Microsoft Word - draft.doc", "scan 12", "Untitled", "chapter_one", "a_b c", "report.PDF", "3f2504e0-4f89-11d3", "deadbeefdeadbeef", "", "  History of Tea ",
    "Document 7", "PowerPoint - slides", "Page of fame", "0123456789abcdef0", "none",
)
AUTHORS = ("A. Writer", "admin", "svc_scan", "Service-1", "Windows User", "Unknown", "owner of it", "", " scanner ")
LANGUAGES = ("en", "en-GB", "e", "engl", "zh-Hant-TW", "de_AT", "fr-", "pt-BR1234567", "pt-BR12345678", "")
URLS = ("https://h/api/chat/completions", "https://h/v1/completions/", "https://h/v1/", " https://h ", "https://h//", "https://h/chat/completions/completions")
ROTATIONS = ("0", "45", "135", "-90", "450", "90.4", "x", "-45", "1e3", "")
KNITS = (
    ("trans-", "port", "a"), ("co-", "worker", "co-worker"), ("co-", "worker", "co-worker,coworker"), ("two-by-", "four", "a"), ("Franco-", "German", "a"), ("1990-", "1995", "a"),
    ("hard­", "ened", "a"), ("plain", "word", "a"), ("trans-", "!", "a"), ("über-", "all", "über-all"), ("two-by-", "four", "two-byfour"),
)


@pytest.mark.parametrize(
    "rule,given,expected",
    [
        (text.usable_title, TITLES, ["Annual report", "", "", "", "", "a_b c", "", "", "", "", "History of Tea", "", "", "Page of fame", "", ""]),
        (text.usable_author, AUTHORS, ["A. Writer", "", "", "", "", "", "owner of it", "", ""]),
        (text.is_language, LANGUAGES, [True, True, False, False, True, False, False, False, False, False]),
        (text.api_root, URLS, ["https://h/api", "https://h/v1", "https://h/v1", "https://h", "https://h", "https://h/chat/completions"]),
        (geometry.rotation, ROTATIONS, [0, 0, 180, 270, 90, 90, 0, 0, 270, 0]),
    ],
)
def test_rules(spark, rule, given, expected):
    rows = spark.createDataFrame(list(enumerate(given)), "id int, value string").select("id", rule(F.col("value")).alias("x")).orderBy("id").collect()
    assert [r["x"] for r in rows] == expected


def test_knit(spark):
    expected = ["trans", "co-", "co", "two-by-", "Franco-", "1990-", "hard", None, None, "über-", "two-by"]
    cases = spark.createDataFrame([(i, *k) for i, k in enumerate(KNITS)], "id int, tail string, lead string, known string")
    rows = cases.select("id", text.knit(F.col("tail"), F.col("lead"), F.split("known", ",")).alias("x")).orderBy("id").collect()
    assert [r["x"] for r in rows] == expected


def test_knit_looks_at_each_word_once(spark, data):
    plan = text_queries.knit_word(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2 and "lambda" not in plan


@pytest.mark.parametrize("title", ["Crème brûlée & Söhne", "ß x", "", "日本", "A" * 200, "--a--"])
def test_slug(spark, title):
    ascii_ = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode()
    parts = "".join(c if c.isalnum() else " " for c in ascii_).lower().split()
    assert one(spark, text.slug(F.col("t")), t=title) == ("-".join(parts)[:80] or "document")


@pytest.mark.parametrize("size", [0, 1, 999_999, 1_000_000, 1_000_001, 2_500_000])
def test_fingerprint(spark, size):
    content = bytes(i * 7 % 251 for i in range(1000)) * (size // 1000 + 1)
    content = content[:size]
    tail = content[max(1_000_000, size - 1_000_000) :] if size > 1_000_000 else b""
    expected = hashlib.sha256(str(size).encode() + content[:1_000_000] + tail).hexdigest()[:16]
    assert one(spark, files.fingerprint(F.col("c")), c=content) == expected


def test_model_json(spark):
    reply = 'Well: {"label": " 3 ", "html": "<p>a .....</p>", "figures": [null, {"id": "fig:x", "bbox": [1, 2, 3], "rotate": 91}]} ok'
    r = one(spark, model_json.result_of(model_json.json_of(F.col("r"))), r=reply)
    assert (r["label"], r["skip"], r["html"], r["notes"]) == ("3", False, "<p>a </p>", "")
    assert [(f["id"], f["bbox"], f["rotate"]) for f in r["figures"]] == [("x", None, 90)]
    assert one(spark, model_json.json_of(F.col("r")), r="no json here") is None


def test_tokens_balance(spark):
    html = "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<script>var t='</p>'</script>"
    open_ = []
    for t in markup.read_tokens(html):
        if t["kind"] == "start":
            # The outermost tag, and those below it that are treated in a way of their own.
            assert t["path"] == open_[:1] + [x for x in open_[1:] if x in markup.MARKED]
            open_.append(t["tag"])
        elif t["kind"] == "end":
            assert open_.pop() == t["tag"]
    assert not open_
    assert one(spark, markup.text_of(markup.tokens(F.col("h"))), h=html) == "a b 1 2 3 x y"
    assert one(spark, markup.text_of(markup.tokens(F.col("h"))), h=None) == ""


def test_deep_markup_takes_its_length_in_time():
    def seconds(depth):
        html = "<div><b>" * depth + "x<img>" + "</b></div>" * depth
        start = time.perf_counter()
        tokens, elements = markup.read_tokens(html), markup.read_elements(html)
        assert len(tokens) == 4 * depth + 2 and elements[0]["images"] == 1 and max(len(t["path"]) for t in tokens) == 1
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_elements_of_nested_markup():
    found = markup.read_elements("<table><tr><th>a<th scope=row>b <a href=x><img> </a></table><h1> <em>T</em>itle</h1><a><a></a>" + "<h2>" + "w" * 99)
    kept = [(x["tag"], x["text"], x["blank"], x["images"], x["headers"], x["unscoped"]) for x in found if x["tag"] in markup.READ]
    assert kept == [("table", "ab  ", False, 1, 2, "a"), ("th", "a", False, 0, 0, None), ("th", "b  ", False, 1, 0, None), ("a", " ", True, 1, 0, None), ("h1", " Title", False, 0, 0, None),
                    ("a", "w" * 60, False, 0, 0, None), ("a", "", True, 0, 0, None), ("h2", "w" * 60, False, 0, 0, None)]


def test_boxes(spark):
    row = spark.createDataFrame([([10.0, 10.0, 10.4, 900.0],), ([5.0, 1.0, 2.0, 3.0],), (None,)], "b array<double>")
    found = row.select(geometry.is_box(F.col("b")).alias("ok"), geometry.crop(F.col("b"), F.lit(100), F.lit(100)).alias("c")).collect()
    assert [r["ok"] for r in found] == [True, False, False]
    assert tuple(found[0]["c"]) == (1, 1, 2, 90)


@pytest.mark.parametrize("sizes,most,expected", [([], 10, []), ([3], 10, [1]), ([0, 0], 10, [2]), ([4, 4, 4, 4], 10, [2, 2]), ([50, 1, 1, 50, 50], 10, [3, 1, 1])])
def test_runs(sizes, most, expected):
    found = list(markup.runs(np.array(sizes, np.int64), most))
    assert [end - start for start, end in found] == expected and [start for start, _ in found] == [sum(expected[:i]) for i in range(len(expected))]


@pytest.mark.parametrize("read", [markup.read_tokens, markup.read_elements])
def test_no_batch_is_held_parsed(read):
    pages = pd.Series([f'<p id="{i}">' + "word " * 2_000 + "</p>" for i in range(200)] + [""])
    parts = list(markup.in_parts(iter([pages, pages[:0]]), read))
    assert max(map(len, parts)) < 40 and len(parts) > 5
    assert [x for part in parts for x in part] == [read(x) for x in pages]


@pytest.mark.parametrize("step", [markup._tokens, markup._elements])
def test_memory_does_not_grow_with_a_batch(step):
    def peak(n):
        batch = pa.array([f"<h1>it\u2019s {i}</h1><p>" + "word " * 4_000 for i in range(n)])
        tracemalloc.start()
        assert sum(map(len, step.func(iter([batch, batch[:0]])))) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(400) < 2 * peak(100)


def test_tree_text_of_pages_in_many_runs(spark, tmp_path):
    texts = {i: " ".join([str(i), *["it\u2019s"] * (i % 7 * 300)]) for i in range(600)} | {600: "", 601: "", 602: "long " * 60_000 + "page"}
    html = {i: f'<h1 id="{i}">{i}</h1>\n<p>{text.removeprefix(str(i))}<script>x</script></p>' for i, text in texts.items()} | {600: None, 601: "", 602: texts[602]}
    spark.createDataFrame(list(html.items()), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert sum(len(x or "") for x in html.values()) > 10 * markup.PART_CHARS
    assert {r["page_id"]: r["text"] for r in catalog.queries()["tree_text"](spark, str(tmp_path)).collect()} == texts
