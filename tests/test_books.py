"""Figures in markup, and books whose files are XML that hangs together."""

import posixpath
import re
import xml.etree.ElementTree as ET

from pagewright.functions.names import free_name
from pagewright.operators import assemble, figures

PAGES = "doc_id string, page_index int, label string, html string, starts_mid_paragraph boolean, ends_mid_paragraph boolean, skip boolean"
FIGURES = "doc_id string, page_index int, id string, alt string, bbox array<double>"


def resolved(spark, rows, known):
    pages = spark.createDataFrame([("d", i, None, html, None, None, False) for i, html in enumerate(rows, 1)], PAGES).repartition(2)
    return figures.resolve(pages, spark.createDataFrame(known, FIGURES))


def test_images(spark):
    box = [1.0, 2.0, 3.0, 4.0]
    known = [("d", 1, "fig:1-1", "A map", None), ("d", 2, "Plan É", "old", None), ("d", 2, "fig:Plan É", "A \"plan\" & <more>", box), ("d", 3, "x", None, box), ("e", 3, "y", "other", box), ("d", 4, None, "z", box)]
    rows = [
        '<figure><img src="fig:1-1" alt="A map of it."></figure><p>a</p><img src="1-1">', 'b<img id="i" src="fig:Plan É"> and <img alt="own" src="fig:Plan É"><img src="fig:gone">', '<p><img src="x" alt="&lt;q&gt; &amp;amp;"></p><IMG src="y">',
        "<p>no image</p>", None, "",
    ]
    found = {r["page_index"]: r["html"] for r in resolved(spark, rows, known).collect()}
    said = '<p class="figure-description"><strong>Image: </strong>{}</p>'
    assert found[1] == f"<figure>{said.format('A map of it.')}</figure><p>a</p>{said.format('A map')}"
    assert found[2] == f'b<img src="figures/p002-plan-e.png" alt="A &quot;plan&quot; &amp; &lt;more&gt;" id="i"> and <img src="figures/p002-plan-e.png" alt="own">{said.format("(no description)")}'
    assert found[3] == f'<p><img src="figures/p003-x.png" alt="&lt;q&gt; &amp;amp;"></p>{said.format("(no description)")}'
    assert (found[4], found[5], found[6]) == ("<p>no image</p>", None, "")
    assert resolved(spark, rows, []).filter("html like '%<img%'").count() == 0


def parsed(spark, rows, **options):
    pages = spark.createDataFrame([(d, i, None, html, None, None, False) for d, i, html in rows], PAGES)
    whole = assemble.assemble(pages, spark.createDataFrame([("d", "A & <B>")], "doc_id string, title string"))
    about = spark.createDataFrame([("d", "A & <B>", "An Author", "de", None)], "doc_id string, title string, author string, language string, source string")
    files: dict = {}
    for r in assemble.book_files(whole, about, **options).collect():
        files.setdefault(r["doc_id"], {})[r["name"]] = r["content"]
    return files


def refers(files):
    """Each file parses, the package names all of them, and each link leads to a place."""
    trees = {name: ET.fromstring(content) for name, content in files.items() if name.endswith((".xhtml", ".opf", ".xml"))}
    opf = "{http://www.idpf.org/2007/opf}"
    items = {i.get("id"): "OEBPS/" + i.get("href") for i in trees["OEBPS/package.opf"].iter(f"{opf}item")}
    assert sorted(v for v in items.values() if "/figures/" not in v) == sorted(n for n in files if n.startswith("OEBPS/") and not n.endswith(".opf")) and len(items) == len(set(items.values()))
    spine = [items[i.get("idref")] for i in trees["OEBPS/package.opf"].iter(f"{opf}itemref")]
    assert spine == sorted(n for n in files if "/text/" in n)
    ids = {name: [x.get("id") for x in tree.iter() if x.get("id")] for name, tree in trees.items()}
    assert all(len(x) == len(set(x)) for x in ids.values())
    links = []
    for name, tree in trees.items():
        for a in tree.iter("{http://www.w3.org/1999/xhtml}a"):
            target, _, place = a.get("href").partition("#")
            target = posixpath.normpath(posixpath.join(posixpath.dirname(name), target)) if target else name
            links.append((name, target, place))
            assert target in trees and (not place or place in ids[target] or place == "nowhere"), (name, a.get("href"))
    return trees, links


def test_book(spark):
    rows = [
        ("d", 1, '<h1>Title</h1><p id="top">go <a href="#end">there</a> &amp; <a href="#top">here</a><a href="#nowhere">x</a><br>\x01</p><h3>Sub<br>title</h3>'),
        ("d", 2, '<blockquote><h2>Inner</h2></blockquote><h2>Two</h2><p><a href="#top" role="doc-noteref">1</a><img src="figures/p.png" alt="a &quot;b&quot;"></p><aside role="doc-footnote" id="n"><p>N</p></aside>'),
        ("d", 3, '<h2>Three</h2><p id="end">a<hr><math xmlns="x"><mi>x</mi></math></p><h4>Deep</h4><h5>Deeper</h5><ol start="3"><li>i</li></ol>'),
        ("e", 1, "<p>No heading</p>"),
    ]
    books = parsed(spark, rows, figures=spark.createDataFrame([("d", "p.png", "image/png")], "doc_id string, file string, mime string"))
    assert set(books) == {"d", "e"} and books["d"]["mimetype"] == "application/epub+zip"
    trees, links = refers(books["d"])
    # The first page's mark stands before the title, in a chapter of its own.
    one, two, three = (next(n for n, c in books["d"].items() if "/text/" in n and mark in c) for mark in ("<h1", ">Two<", ">Three<"))
    assert three == "OEBPS/text/ch005.xhtml"
    assert {(one, three, "end"), (one, one, "top"), (two, one, "top"), (one, one, "nowhere")} <= set(links)
    assert '<a href="ch005.xhtml#end">' in books["d"][one] and 'epub:type="footnote"' in books["d"][two] and 'src="../figures/p.png"' in books["d"][two]
    nav = books["d"]["OEBPS/nav.xhtml"]
    assert re.sub(r' href="[^"]*"', "", nav.split("<h1>Contents</h1>")[1].split("</nav>")[0]) == "<ol><li><a>Title</a><ol><li><a>Sub title</a></li><li><a>Inner</a></li><li><a>Two</a></li><li><a>Three</a><ol><li><a>Deep</a></li></ol></li></ol></li></ol>"
    assert nav.count("doc-pagebreak") == 0 and [a.text for a in trees["OEBPS/nav.xhtml"].iter("{http://www.w3.org/1999/xhtml}a")][-4:] == ["1", "2", "3", "Start of content"]
    assert "A &amp; &lt;B&gt;" in books["d"]["OEBPS/package.opf"] and "<dc:creator>An Author" in books["d"]["OEBPS/package.opf"] and "printPageNumbers" in books["d"]["OEBPS/package.opf"]
    refers(books["e"])
    plain = parsed(spark, rows, numbered=False)["d"]
    assert not any("pagebreak" in c for n, c in plain.items() if n.endswith("xhtml")) and "printPageNumbers" not in plain["OEBPS/package.opf"]


def test_books_of_the_tables(spark, data):
    from pagewright.sources.adapters import pages

    files: dict = {}
    for r in assemble.book_files(assemble.assemble(pages(spark, data))).collect():
        files.setdefault(r["doc_id"], {})[r["name"]] = r["content"]
    assert len(files) > 5
    for own in files.values():
        refers(own)


def test_many_equal_names():
    taken: dict = {}
    names = [free_name(n, "b", taken) for n in ["3", "3b", "3", "3", "3b", "3bb", "4"] + ["5"] * 2000]
    assert names[:7] == ["3", "3b", "3bb", "3bbb", "3bbbb", "3bbbbb", "4"] and len(set(names)) == len(names) and names[-1] == "5" + "b" * 1999
