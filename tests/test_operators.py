import io
import itertools
import re
import zipfile

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import align, assemble, html_checks, outline, sanitize, state
from pagewright.plans.page_queries import line_words
from pagewright.sources import files
from pagewright.streaming import edits

CLEAN = [
    ("<div><p>a</p><div>b<b>c</b></div></div>", "<p>a</p><p>b<strong>c</strong></p>"),
    ("<p>x<script>bad()</script>y</p>", "<p>xy</p>"),
    ("<p><img src='a.png' onclick=x></p>", '<figure><img alt="" src="a.png"></figure>'),
    ("<p> </p><h2></h2><p>k</p>", "<p>k</p>"),
    ("<ol start='x' type='a'><li>q</li></ol>", '<ol type="a"><li>q</li></ol>'),
    ("<span class='small-caps wrap'>S</span><span>t</span>", '<p><span class="small-caps">S</span>t</p>'),
    ("<p><a href='javascript:x'>l</a></p>", "<p><a>l</a></p>"),
    ("<p class='align-left foo' style='c'>z</p>", '<p class="align-left">z</p>'),
    ("<math display='block'><mi mathvariant='b'>x</mi></math>", '<p><math display="block"><mi>x</mi></math></p>'),
    ("", ""),
    ("a < b", "<p>a &lt; b</p>"),
]


def test_sanitize(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "id int, html string")
    once = sanitize.sanitize(df)
    assert [r["html"] for r in once.orderBy("id").collect()] == [b for _, b in CLEAN]
    assert [r["html"] for r in sanitize.sanitize(once).orderBy("id").collect()] == [b for _, b in CLEAN]


def test_layout_is_dropped(spark):
    """Markup that is laid out in lines comes to the same as markup in one line; a space between inline elements is text."""
    flat = (
        '<ul><li>one <em>a</em> <strong>b</strong></li><li>two<ul><li>y</li></ul></li></ul><figure><img alt="x" src="f"><figcaption>cap <em>x</em></figcaption></figure>'
        '<table><caption>c</caption><tbody><tr><th scope="col">h</th><td>d</td></tr></tbody></table><dl><dt>t</dt><dd>d</dd></dl><pre>a\n  b <em> c </em>\n</pre>'
    )
    laid = re.sub(r"(<(?:ul|figure|table|tbody|tr|dl)\b[^>]*>|</(?:li|ul|figcaption|caption|th|td|tr|tbody|table|figure|dt|dd|dl)>|<img[^>]*>)", "\\1\n   ", flat).replace("two<ul>", "two\n <ul>")
    rows = spark.createDataFrame([(1, flat), (2, laid), (3, "<figure> <img src=f alt=x> <figcaption> c </figcaption> </figure>"), (4, "<p>a <em>b</em> <em>c</em> </p> <p> d</p>")], "id int, html string")
    found = [r["html"] for r in sanitize.sanitize(rows).orderBy("id").collect()]
    assert found[0] == found[1] == flat
    assert found[2:] == ['<figure><img alt="x" src="f"><figcaption> c </figcaption></figure>', "<p>a <em>b</em> <em>c</em> </p><p> d</p>"]


def test_sanitize_is_idempotent(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html")
    once = sanitize.sanitize(pages)
    twice = sanitize.sanitize(once).withColumnRenamed("html", "again")
    assert once.join(twice, "page_id").filter("html <> again").count() == 0


def kinds(scan, typed):
    return [k for k, _, _ in align.differences(scan.split(), typed.split())]


def test_differences():
    assert kinds("a b c", "a b c") == []
    assert kinds("one two three", "one three") == ["missing"]
    assert kinds("one three", "one two three") == ["extra"]
    assert kinds("the fox ran", "the fax ran") == ["changed"]
    assert kinds("to gether now", "together now") == []
    body, note = "alpha beta gamma delta epsilon zeta", "first second third fourth"
    assert kinds(f"{note} {body}", f"{body} {note}") == []
    assert kinds("", "") == [] and kinds("", "x") == ["extra"]


def test_pairs_in_order_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        similar = rng.random(rng.integers(0, 6, 2)) < 0.4
        found = align.in_order(similar)
        assert all(similar[p] for p in found) and all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(found))
        cells = [tuple(map(int, x)) for x in np.argwhere(similar)]
        best = {}
        for i, j in sorted(cells, reverse=True):
            best[i, j] = 1 + max((n for (a, b), n in best.items() if a > i and b > j), default=0)
        assert len(found) == max(best.values(), default=0)


def test_page_diff(spark):
    rows = [("d", 1, 0, "inter-", 0.0, 0.0, 50.0, 10.0), ("d", 1, 1, "national", 0.0, 20.0, 80.0, 30.0), ("d", 1, 2, "law", 90.0, 20.0, 99.0, 30.0), ("d", 2, 0, "alone", 0.0, 0.0, 9.0, 9.0)]
    words = spark.createDataFrame(rows, "doc_id string, page_index int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    typed = spark.createDataFrame([("d", 1, ["international", "laws", "here"]), ("d", 3, ["new"])], "doc_id string, page_index int, typed array<string>")
    found = align.page_diff(words, typed)
    assert sorted((r["page_index"], r["kind"], r["text"], len(r["boxes"] or [])) for r in found.collect()) == [(1, "changed", "law", 1), (1, "extra", "here", 0), (2, "missing", "alone", 1), (3, "extra", "new", 0)]
    assert {r["page_index"]: tuple(r)[2:] for r in align.diff_counts(found).collect()} == {1: (0, 1, 1), 2: (1, 0, 0), 3: (0, 1, 0)}


def test_scan_tokens(spark):
    rows = [("d", 1, 0, "inter-", 0.0, 0.0, 50.0, 10.0), ("d", 1, 1, "national", 0.0, 20.0, 80.0, 30.0), ("d", 1, 2, "a-", 90.0, 20.0, 95.0, 30.0), ("d", 1, 3, "b", 96.0, 20.0, 99.0, 30.0)]
    found = align.scan_tokens(spark.createDataFrame(rows, "doc_id string, page_index int, pos int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [(r["text"], len(r["boxes"])) for r in found.orderBy("pos").collect()] == [("inter-national", 2), ("a-", 1), ("b", 1)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, page_index int, label string, html string, starts_mid_paragraph boolean, ends_mid_paragraph boolean, skip boolean")


def test_assemble(spark):
    rows = [
        ("d", 1, "3", "<h1>T</h1><p>one inter-</p>", False, False, False),
        ("d", 2, "3b", "<p>skipped</p>", False, False, True),
        ("d", 3, "3", "<p>national law</p><ol><li>a</li><li>b</li></ol>", False, False, False),
        ("d", 4, None, '<ol start="3"><li>c</li></ol><p>to be</p>', False, True, False),
        ("d", 5, "x", "<p>Continued</p>", True, False, False),
        ("d", 6, "y", "<h2>New</h2>", True, False, False),
        ("e", 1, None, " ", False, False, False),
    ]
    found = assemble.assemble(pages(spark, rows)).collect()
    assert [r["doc_id"] for r in found] == ["d"]
    html = found[0]["html"]
    # A mark has its label as text and is told as "Page ..."; that of a list that goes on stands at the head of its first item.
    mark = '<{0} role="doc-pagebreak" id="{1}" aria-label="Page {2}" title="Page {2}">{2}</{0}>'.format
    assert f'one inter{mark("span", "pg-3b", "3")}national law</p>' in html
    assert f'<li>b</li><li>{mark("span", "pg-4", "4")}c</li></ol>' in html
    assert f'to be {mark("span", "pg-x", "x")}Continued</p>' in html
    assert f'</p>{mark("div", "pg-y", "y")}<h2 id="h-2">New</h2>' in html
    assert [p["id"] for p in found[0]["page_ids"]] == ["pg-3", "pg-3b", "pg-4", "pg-x", "pg-y"]


def test_page_ids_are_first_free(spark):
    rows = [("d", i, label, "<p>x</p>", False, False, False) for i, label in enumerate(["3", "3b", "3", "3"], 1)]
    assert [r["page_id"] for r in outline.page_ids(pages(spark, rows)).orderBy("page_index").collect()] == ["pg-3", "pg-3b", "pg-3bb", "pg-3bbb"]


def test_levels(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 4, 6, 2, 5])], "doc_id int, ord int, level int")
    assert [r["new_level"] for r in outline.without_skips(df).orderBy("ord").collect()] == [1, 2, 3, 4, 2, 3]
    many = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 3)], "doc_id int, ord int, level int")
    assert [tuple(r) for r in outline.normalised(many).orderBy("doc_id", "ord").select("doc_id", "ord", "new_level").collect()] == [(1, -1, 1), (1, 0, 2), (1, 1, 2), (2, -1, 1), (2, 0, 2)]


def test_books(spark, data):
    from pagewright.sources.adapters import pages as adapted

    files_ = assemble.book_files(assemble.assemble(adapted(spark, data)))
    row = assemble.books(files_).orderBy("doc_id").first()
    with zipfile.ZipFile(io.BytesIO(row["epub"])) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert {"OEBPS/nav.xhtml", "OEBPS/package.opf", "META-INF/container.xml"} <= set(z.namelist())


def test_page_numbers():
    assert state.page_numbers("3,1-2,9-,-1", 10) == [1, 2, 3, 9, 10]
    assert state.page_numbers("all", 3) == [1, 2, 3]
    assert state.page_numbers("7-9", 3) == []


def test_project_round_trip(spark):
    docs = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    own = spark.createDataFrame([("d", 2, "b", 4), ("d", 1, "a", 3)], "doc_id string, page_index int, html string, version int")
    projects = files.export_projects(docs, own)
    back = files.import_pages(projects)
    assert [(r["page_index"], r["html"], r["version"], r["error"]) for r in back.orderBy("page_index").collect()] == [(1, "a", 3, None), (2, "b", 4, None)]
    bad = spark.createDataFrame([("x", "{}"), ("y", '{"format": "pagewright-project", "version": 9, "pages": []}')], "doc_id string, project string")
    assert {r["doc_id"]: r["error"] for r in files.import_pages(bad).collect()} == {"x": "not a project", "y": "version not known"}


def test_line_words_cover_their_lines(spark, data):
    found = line_words(spark, data).groupBy("doc_id", "page_index", "line").agg(F.max("x1").alias("x1"), F.min("x0").alias("x0")).collect()
    # The last word's box ends by one space beyond the line.
    assert all(abs(r["x0"]) < 1e-6 and r["x1"] > 1000 for r in found)


def test_line_words_share_the_line(spark):
    lines = spark.createDataFrame([("d", 1, 0, " ab  c ", 100.0, 0.0, 200.0, 10.0), ("d", 1, 1, " ", 0.0, 0.0, 9.0, 9.0)], "doc_id string, page_index int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["word"], r["x0"], r["x1"]) for r in align.line_words(lines).orderBy("word_no").collect()] == [("ab", 100.0, 175.0), ("c", 175.0, 225.0)]


def test_decide():
    assert edits.decide([0, 0, None, 2, 3], 0) == ([(1, "accepted"), (1, "conflict"), (2, "accepted"), (3, "accepted"), (4, "accepted")], 4)


FINDINGS = [
    (None, [("error", "lang", ""), ("error", "title", ""), ("warning", "h1-count", ""), ("warning", "no-pagebreaks", "")]),
    (
        """<html lang='en'><head><title>T</title></head><body><h1>A</h1><h3>Deep <b>x</b></h3><h2> <br></h2><h2></h2><img alt=''><img alt=" " src=a.png><img src='data:xx' id=q>
        <table><tr><td><table><tr><th>in<th scope=col>c</table></td></tr></table><table><tr><td>plain</td></tr></table><a href=#q></a><a href='#no'>n</a><a href="/x"><img alt="y"></a>
        <p id=q style="c">p</p><p style=d id='one'></p><div role=doc-pagebreak></div></body></html>""",
        [
            ("warning", "heading-skip", "Deep x"), ("error", "empty-heading", ""), ("error", "empty-heading", ""), ("info", "img-alt-empty", ""), ("info", "img-alt-empty", "a.png"), ("error", "img-alt", "embedded image (q)"),
            ("info", "th-scope", "in"), ("info", "th-scope", "in"), ("warning", "table-th", "plain"), ("error", "link-text", "#q"), ("warning", "broken-fragment", ""), ("error", "dup-id", ""), ("info", "inline-style", ""), ("info", "presentational", ""),
        ],
    ),
]


def test_findings_at_each_element(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(FINDINGS)], "page_id int, html string")
    found = html_checks.findings(df).collect()
    for i, (_, expected) in enumerate(FINDINGS):
        assert sorted((r["severity"], r["code"], r["location"]) for r in found if r["page_id"] == i) == sorted(expected)
    assert {r["message"] for r in found if r["code"] == "dup-id"} == {"id used 2 times: q"}
    assert html_checks.findings(df.limit(0)).count() == 0


def test_findings_agree_with_the_checks_of_pages(spark, data):
    """On the test pages, which a regular expression can read."""
    pages_ = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html")
    ours = html_checks.findings(pages_).select("page_id", "severity", "code").filter("code not in ('th-scope', 'link-text', 'presentational')").distinct()
    theirs = html_checks.issues(pages_).filter("code not like 'presentational%'").distinct()
    assert ours.exceptAll(theirs).count() == theirs.exceptAll(ours).count() == 0
