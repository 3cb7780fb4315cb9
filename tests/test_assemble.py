"""Pages put together: edges through containers, lists, notes, headings and ids."""

import random
import re

import pyarrow as pa
import pytest

from pagewright.functions.tree import read, write
from pagewright.operators import assemble

SHAPE = "doc_id string, page_index int, label string, html string, starts_mid_paragraph boolean, ends_mid_paragraph boolean, skip boolean, status string"


def built(spark, *pages, title="Book"):
    """(label, html, starts, ends) of the pages -> the row of their document."""
    rows = [("d", i, label, html, starts, ends, False, "needs_review") for i, (label, html, starts, ends) in enumerate(pages, 1)]
    rows += [("other", 1, "1", "<p>x</p>", None, None, None, None)]
    found = assemble.assemble(spark.createDataFrame(rows, SHAPE).repartition(2), spark.createDataFrame([("d", title)], "doc_id string, title string"))
    return found.filter("doc_id = 'd'").first()


def mark(number, tag="span"):
    return f'<{tag} role="doc-pagebreak" id="pg-{number}" aria-label="Page {number}" title="Page {number}">{number}</{tag}>'


def test_item_over_a_page(spark):
    row = built(spark, ("1", "<h1>T</h1><ol><li>one</li><li>two begins</li></ol>", False, True), ("2", '<ol start="2"><li>and ends</li><li>three</li></ol><p>After.</p>', True, False))
    assert row["html"] == f'{mark(1, "div")}<h1 id="h-1">T</h1><ol><li>one</li><li>two begins {mark(2)}and ends</li><li>three</li></ol><p>After.</p>' and not row["warnings"] and row["n_merged"] == 1


def test_nested_lists_over_a_page(spark):
    row = built(spark, ("1", "<h1>T</h1><ol><li>a<ul><li>b</li><li>c be</li></ul></li></ol>", False, True), ("2", "<ol><li><ul><li>gins</li><li>d</li></ul></li><li>e</li></ol>", True, False))
    assert row["html"].endswith(f"<ol><li>a<ul><li>b</li><li>c be {mark(2)}gins</li><li>d</li></ul></li><li>e</li></ol>")


def test_lists_that_follow(spark):
    pages = ("1", '<h1>T</h1><ol type="a"><li>one</li></ol><aside role="doc-footnote" id="n1"><p>Note.</p></aside>', False, False), ("2", '<ol type="a" start="2"><li><p>two</p></li></ol>', False, False), ("3", '<ol type="a" start="9"><li>x</li></ol>', False, False)
    row = built(spark, *pages)
    assert f'<ol type="a"><li>one</li><li><p>{mark(2)}two</p></li></ol><aside role="doc-footnote"' in row["html"] and '<ol type="a" start="9">' in row["html"]
    assert [w.split(":")[0] for w in row["warnings"]] == ["page 3"]


def test_edges_through_containers_and_past_notes(spark):
    note = '<aside role="doc-footnote" id="n"><p>Note.</p></aside>'
    row = built(spark, ("1", f"<h1>T</h1><blockquote><p>It begins</p></blockquote>{note}", False, True), ("2", f"{note}<section><p>and <em>ends</em></p></section><p>Next.</p>", True, False))
    second = note.replace('"n"', '"n-2"')
    assert row["html"].endswith(f"<blockquote><p>It begins {mark(2)}and <em>ends</em></p></blockquote>{note}{second}<p>Next.</p>") and len(row["warnings"]) == 1


def test_whole_pages_go_into_one_paragraph(spark):
    row = built(spark, ("1", "<h1>T</h1><p>a inter-</p>", False, False), ("2", "<p>national b</p>", False, True), ("3", "<p>c</p>", True, True), ("4", "<table><tr><td>x</td></tr></table>", True, False), ("5", "<p>d</p>", False, False))
    assert f"<p>a inter{mark(2)}national b {mark(3)}c</p>{mark(4, 'div')}<table>" in row["html"] and row["n_merged"] == 2


@pytest.mark.parametrize(
    "tail,lead,known,whole",
    [("inter-", "national", "", "inter"), ("self-", "government", "self-government", "self-"), ("self-", "government", "self-government selfgovernment", "self"), ("mother-in-", "law", "", "mother-in-"),
     ("mother-in-", "law", "mother-inlaw", "mother-in"), ("Anglo-", "Saxon", "", "Anglo-"), ("1914-", "1918", "", "1914-"), ("in­", "side", "", "in"), ("end", "word", "", None), ("in-", "!", "", None)],
)
def test_knit(tail, lead, known, whole):
    assert assemble.knit(tail, lead, set(known.split())) == whole


def test_words_of_the_document_decide(spark):
    row = built(spark, ("1", "<h1>T</h1><p>self-government, co‐operate</p><p>the self-</p>", False, False), ("2", "<p>government of self-</p>", False, False), ("3", "<p>ish men to co-</p>", False, False), ("4", "<p>operate</p>", False, False))
    assert f"the self-{mark(2)}government of self{mark(3)}ish men to co-{mark(4)}operate" in row["html"]


def test_headings_and_ids(spark):
    row = built(spark, ("1", "<h1>Part A</h1><p>a</p>", False, False), ("2", '<h1 id="h-1">Part B</h1><h4>Deep</h4><p id="x">b</p><p id="x">c</p>', False, False), ("3", '<p id="x">c</p><p id="x-2">d</p><h6>e</h6>', False, False))
    assert re.findall(r"<(h\d) id=\"([^\"]*)\">([^<]*)", row["html"]) == [("h1", "h-1", "Book"), ("h2", "h-2", "Part A"), ("h2", "h-1-2", "Part B"), ("h3", "h-3", "Deep"), ("h4", "h-4", "e")]
    ids = re.findall(r'id="([^"]*)"', row["html"])
    assert len(ids) == len(set(ids)) and {"x", "x-2", "x-3", "x-2-2"} <= set(ids) and len(row["warnings"]) == 4


def test_pages_without_text(spark):
    rows = [("d", 1, None, None, None, None, None, "pending"), ("d", 2, "", " ", False, False, False, "error"), ("d", 3, "A é", "bare & <b>text</b>", None, None, None, None), ("d", 4, "x", "<p>s</p>", True, True, True, "done"), ("e", 1, None, "", None, None, False, "pending")]
    found = assemble.assemble(spark.createDataFrame(rows, SHAPE)).collect()
    assert [(r["doc_id"], r["n_pages"], r["warnings"]) for r in found] == [("d", 1, ["page 1: not read yet"])]
    assert found[0]["html"].startswith('<h1 id="h-1">d</h1><div role="doc-pagebreak" id="pg-a-e" ') and found[0]["html"].endswith("<p>bare &amp;</p><b>text</b>")
    assert assemble.assemble(spark.createDataFrame([], SHAPE)).count() == 0


def test_trees_round_trip():
    rng = random.Random(1)

    def some(depth):
        inside = "".join(some(depth - 1) if rng.random() < 0.6 and depth else rng.choice(["a", "&amp;", " ", "&lt;b"]) for _ in range(rng.randint(0, 3)))
        tag = rng.choice(["section", "em", "blockquote", "span"])
        return rng.choice([f'<{tag} id="x&quot;&gt;">{inside}</{tag}>', "<br>", inside])

    for _ in range(200):
        html = some(5)
        assert write(read(html)) == html
    deep = "<section>" * 3000 + "x" + "</section>" * 3000
    assert write(read(deep)) == deep


def text_of(html):
    return re.sub(r"\s+", "", re.sub(r"<(span|div) role=\"doc-pagebreak\"[^>]*>[^<]*</\1>|<[^>]*>", "", html))


@pytest.mark.parametrize("seed", range(4))
def test_nothing_is_lost(spark, seed):
    """Whatever the pages hold, their text comes out once, in order but for footnotes, with each page's mark, one title and no id twice."""
    rng = random.Random(seed)
    word = iter(range(10**6))

    def block(depth=2):
        kind = rng.choice(["p", "p", "h1", "h3", "ul", "ol", "blockquote", "table"])
        if kind in ("p", "h1", "h3", "table") or not depth:
            inner = f"w{next(word)} <em>w{next(word)}</em>" + rng.choice(["", " z", " w."])
            return f"<table><tbody><tr><td>{inner}</td></tr></tbody></table>" if kind == "table" else f'<{kind if kind in ("p", "h1", "h3") else "p"} id="i{rng.randint(0, 5)}">{inner}</{kind if kind in ("p", "h1", "h3") else "p"}>'
        inside = [block(depth - 1) if rng.random() < 0.4 or kind == "blockquote" else f"w{next(word)}" for _ in range(rng.randint(1, 3))]
        return f"<{kind}{rng.choice(['', ' start=\"3\"']) if kind == 'ol' else ''}>" + "".join(f"<li>{x}</li>" if kind != "blockquote" else x for x in inside) + f"</{kind}>"

    pages = [(rng.choice([None, "", "7", "7b", str(n)]), "".join(block() for _ in range(rng.randint(1, 3))), rng.random() < 0.6, rng.random() < 0.6) for n in range(25)]
    row = built(spark, *pages)
    tops = sum(p[1].count("<h1") for p in pages)
    assert text_of(row["html"]) == ("" if tops == 1 else "Book") + "".join(text_of(p[1]) for p in pages)
    ids = re.findall(r'id="([^"]*)"', row["html"])
    assert len(ids) == len(set(ids)) and row["n_pages"] == 25 == row["html"].count('role="doc-pagebreak"')
    levels = [int(x) for x in re.findall(r"<h(\d)", row["html"])]
    assert levels.count(1) == 1 and levels[0] == 1 or tops == 1
    assert all(b <= a + 1 for a, b in zip(levels, levels[1:], strict=False))
    assert write(read(row["html"])) == row["html"]


def test_fold_gives_out_pages_in_runs():
    n = 300
    pages = {
        "doc_id": ["a"] * 200 + ["b"] * 100, "page_index": [*range(200), *range(100)], "label": [str(i) for i in range(n)], "html": ["<p>" + "word " * 1_000 + "</p>"] * n, "starts": [i % 3 == 0 for i in range(n)],
        "ends": [i % 3 == 2 for i in range(n)], "title": ["t"] * n, "tops": [0] * n, "known": [None] * 100 + [["over-all"]] * 200, "name": [f"pg-{i}" for i in range(n)],
    }
    whole = pa.RecordBatch.from_pydict(pages, schema=pa.schema([("doc_id", pa.string()), ("page_index", pa.int32()), ("label", pa.string()), ("html", pa.string()), ("starts", pa.bool_()), ("ends", pa.bool_()), ("title", pa.string()), ("tops", pa.int64()), ("known", pa.list_(pa.string())), ("name", pa.string())]))
    given = list(assemble._folded(iter([whole])))
    assert max(b.num_rows for b in given) < 150
    assert [r for b in given for r in b.to_pylist()] == [r for b in assemble._folded(whole.slice(i, 1) for i in range(n)) for r in b.to_pylist()]
    assert sum(r["kind"] == "page" for b in given for r in b.to_pylist()) == n


def test_pages_are_made_once(spark):
    """Whatever makes the pages runs once for each, though their words, headings and markup are all asked for."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(f"d{i % 5}", i, None, "<p>a inter-</p>" if i < 30 else None, False, False, False, "pending") for i in range(40)]
    found = assemble.assemble(spark.createDataFrame(rows, SHAPE).mapInArrow(counted, SHAPE)).collect()
    assert sorted(r["doc_id"] for r in found) == [f"d{i}" for i in range(5)] and all(r["n_pages"] == 6 and len(r["warnings"]) == 2 for r in found)
    assert made.value == 40


def test_words_decide_in_their_own_document(spark):
    """Documents with and without broken words, without an id, with a compound or without, and with pages that come twice."""
    compound, broken, rest = "<h1>T</h1><p>self-ish</p>", "<p>the self-</p>", "<p>ish b</p>"
    pages = [(d, i, str(i), html, False, False, None, "done") for d, own in (("a", (compound, broken, rest)), ("b", ("<h1>T</h1>", broken, rest)), ("c", (compound, rest, rest)), (None, (compound, broken, rest))) for i, html in enumerate(own, 1)]
    pages += [("e", i, str(i), html, False, False, None, "done") for i, html in enumerate((compound, broken, rest), 1) for _ in range(2)]
    found = {r["doc_id"]: r["html"] for r in assemble.assemble(spark.createDataFrame(pages, SHAPE).repartition(3)).collect()}
    assert f"the self-{mark(3)}ish b" in found["a"] and f"the self{mark(3)}ish b" in found["b"] and found["c"].endswith(f"{mark(3, 'div')}<p>ish b</p>")
    # Without an id no words of the document are found.
    assert f"the self{mark(3)}ish b" in found[None]
    assert found["e"].count("doc-pagebreak") == 6 and f"the self-{mark(3)}ish b" in found["e"]


def test_fold_takes_what_is_known_from_a_row_before_the_pages():
    names = ["doc_id", "page_index", "label", "html", "starts", "ends", "title", "tops", "known", "name"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
    rows = [("d", None, None, None, None, None, "Book", 0, ["self-ish"], None), ("d", 1, "1", "<p>a self-</p>", False, False, None, None, None, "pg-1"), ("d", 2, "2", "<p>ish</p>", False, False, None, None, None, "pg-2")]
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, types, strict=True))))
    told = [r for i in range(3) for r in [whole.slice(i, 1)]]
    given = [r for b in assemble._folded(iter(told)) for r in b.to_pylist()]
    assert [r["label"] for r in given if r["kind"] == "page"] == ["1", "2"]
    assert "".join(r["body"] for r in given if r["kind"] == "html") == f'<h1 id="h-1">Book</h1>{mark(1, "div")}<p>a self-{mark(2)}ish</p>'


def test_markup_is_not_shuffled_to_find_few_broken_words(spark, capsys):
    """Where few documents have a broken word, they are found among the pages by a broadcast as large as the words are."""
    rng = random.Random(3)
    rows = [(f"d{i % 20}", i, None, "<p>" + " ".join(str(rng.random()) for _ in range(200)) + (" self-" if i == 7 else "") + "</p>", False, False, False, "done") for i in range(100)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 20_000)
    try:
        found = assemble.pieces(spark.createDataFrame(rows, SHAPE))
        found.explain()
        assert sum("BroadcastHashJoin" in x and "LeftSemi" in x for x in capsys.readouterr().out.splitlines()) == 1
        assert found.filter("kind = 'page'").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
