"""Pages put together to one document, and what is made of it.

Pages are shuffled once, by document, and folded in their order. The fold keeps the last block of the document so far, which
the next page may go on with, and gives out all before it as finished markup: a task holds two pages at a time and the ids of
one document, however many pages there are. What the fold has to know of the whole document comes in a row before its pages:
its title, how many headings of level 1 there are, and which words decide on hyphens.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import text
from pagewright.functions.markup import in_parts, runs
from pagewright.functions.names import free_name
from pagewright.functions.tree import Node, read, within, write
from pagewright.operators import exports, outline
from pagewright.sources.places import written

# Blocks of text and what holds them, blocks that go on over a page's edge, and what a broken word ends with.
TEXTS = frozenset("p li dd dt h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("blockquote ul ol section aside dl div".split())
JOINED = frozenset("p li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LETTERS = r"[^\W\d_]+"
BROKEN = re.compile(rf"(?:({_LETTERS}(?:[-‐]{_LETTERS})*)|\d)[-‐­]$")
_LEAD = re.compile(_LETTERS)
#: The same for a page's whole text: the stems of words that are broken anywhere.
BROKEN_WORDS = r"([\p{L}]+(?:[-‐][\p{L}]+)*)[-‐](?=\s|<|$)"


def _marker(tag: str, page_id: str, label: str) -> Node:
    said = f"Page {label}"
    return Node(tag, {"role": "doc-pagebreak", "id": page_id, "aria-label": said, "title": said}, [label])


def _is_note(x: Node | str) -> bool:
    return isinstance(x, Node) and x.tag == "aside" and x.attrs.get("role") == "doc-footnote"


def _edge(inside: list[Node | str], end: int) -> list[Node] | None:
    """The elements from the outermost one down to the first (end 0) or last (-1) block of text, past footnotes; None if something else stands there."""
    chain: list[Node] = []
    while True:
        found = [x for x in inside if isinstance(x, Node) and not _is_note(x)]
        if not found:
            return None
        node = found[end]
        chain.append(node)
        own = node.elements()
        holds = node.tag == "li" and bool(own) and own[end].tag in TEXTS | CONTAINERS
        if node.tag in TEXTS and not holds:
            return chain
        if not holds and (node.tag not in CONTAINERS or node.attrs.get("role") == "doc-pagebreak"):
            return None
        inside = node.inside


def _text_at(node: Node, end: int) -> str:
    return node.inside[end] if node.inside and isinstance(node.inside[end], str) else ""


def knit(tail: str, lead: str, known: frozenset[str] | set[str]) -> str | None:
    """How a text that ends in a broken word goes on: itself as it stands before the lead, or None if no word is broken.

    A soft hyphen goes. A hyphen stays before a capital or a digit, and, unless the document spells the word without it, after
    a compound and where the document spells the word with it.
    """
    found = BROKEN.search(tail)
    if not found or not lead[:1].isalnum():
        return None
    if tail[-1] == "\u00ad":
        return tail[:-1]
    stem, rest = found.group(1), _LEAD.match(lead)
    if stem is None or rest is None or not lead[0].islower():
        return tail
    stem, rest = stem.lower().replace("‐", "-"), rest.group().lower()
    stays = stem + rest not in known and ("-" in stem or f"{stem}-{rest}" in known)
    return tail if stays else tail[:-1]


class _Fold:
    """One document, page after page."""

    def __init__(self, title: str, tops: int, known: set[str]) -> None:
        self.tops, self.known = tops, known
        #: The last block and the footnotes behind it: all that may still change.
        self.tail: list[Node | str] = []
        self.ended: bool | None = None
        self.level, self.headings, self.used, self.next_of, self.page_ids = 1, 0, set(), {}, {}
        self.warnings: list[str] = []
        if tops != 1:
            self.tail.append(Node("h1", {"title-of": ""}, [title]))

    def page(self, index: int, name: str, label: str, markup: str, starts: bool, ends: bool) -> tuple[str, str, bool]:
        """Adds a page: its id, the markup that is finished by it, and whether it goes on with the block before."""
        page_id = free_name(name, "b", self.page_ids)
        nodes = read(markup)
        merged = False
        if self.ended is not None:
            back, front = _edge(self.tail, -1), _edge(nodes, 0)
            merged = bool(back and front) and self._goes_on(back, front, starts) and self._join(back, front, nodes, _marker("span", page_id, label))
            merged = merged or self._join_lists(nodes, _marker("span", page_id, label), index)
        if not merged:
            self.tail.append(_marker("div", page_id, label))
        if nodes and isinstance(nodes[0], str):
            lead = nodes.pop(0).strip()
            self.tail += [Node("p", {}, [lead])] if lead else []
        self.tail += nodes
        self.ended = ends
        last = max((i for i, x in enumerate(self.tail) if isinstance(x, Node) and not _is_note(x)), default=0)
        done, self.tail = self.tail[:last], self.tail[last:]
        return page_id, self._finished(done), merged

    def _goes_on(self, back: list[Node], front: list[Node], starts: bool) -> bool:
        broken = _text_at(front[-1], 0)[:1].islower() and BROKEN.search(_text_at(back[-1], -1).rstrip())
        return bool(self.ended and starts or broken)

    def _join(self, back: list[Node], front: list[Node], nodes: list[Node | str], marker: Node) -> bool:
        """The first block's content behind that of the last one, and the items after it behind theirs."""
        into, block = back[-1], front[-1]
        if into.tag in HEADINGS or into.tag != block.tag and not {into.tag, block.tag} <= JOINED:
            return False
        tail, lead = _text_at(into, -1).rstrip(), _text_at(block, 0)
        whole = knit(tail, lead, self.known)
        if into.inside and isinstance(into.inside[-1], str):
            into.inside.pop()
        into.inside += [tail + " " if whole is None else whole, marker, lead if whole is None else lead.lstrip()]
        into.inside += block.inside[1:] if block.inside and isinstance(block.inside[0], str) else block.inside
        # Items behind a joined item belong to the list before, and so on outwards through nested lists.
        for k in range(1, min(len(back), len(front)), 2):
            lists = back[-k - 1], front[-k - 1]
            if back[-k].tag != "li" or front[-k].tag != "li" or lists[0].tag != lists[1].tag or lists[0].tag not in ("ol", "ul"):
                break
            at = next(i for i, x in enumerate(lists[1].inside) if x is front[-k]) + 1
            lists[0].inside += lists[1].inside[at:]
            del lists[1].inside[at:]
        # What is left empty around the block goes with it.
        for node, holder in zip(front[::-1], [*[n.inside for n in front[:-1]][::-1], nodes], strict=True):
            if node is not block and any(isinstance(x, Node) or x.strip() for x in node.inside):
                break
            holder[:] = [x for x in holder if x is not node]
        return True

    def _join_lists(self, nodes: list[Node | str], marker: Node, index: int) -> bool:
        """A numbered list that starts at the number which the one before would have next goes on with it."""
        before = next((x for x in reversed(self.tail) if isinstance(x, Node) and not _is_note(x)), None)
        at = next((i for i, x in enumerate(nodes) if isinstance(x, Node)), None)
        if before is None or at is None or any(x.strip() for x in nodes[:at]):
            return False
        own = nodes[at]
        items = [x for x in own.elements() if x.tag == "li"]
        if before.tag != "ol" or own.tag != "ol" or "start" not in own.attrs or not items or (before.attrs.get("type") or "1") != (own.attrs.get("type") or "1"):
            return False
        following = _start(before) + sum(x.tag == "li" for x in before.elements())
        if _start(own) != following:
            self.warnings.append(f"page {index}: a list starts at {_start(own)} where {following} would follow; not joined")
            return False
        host = items[0]
        if not _text_at(host, 0).strip() and host.elements() and host.elements()[0].tag == "p":
            host = host.elements()[0]
        host.inside.insert(0, marker)
        before.inside += own.inside
        del nodes[at]
        return True

    def _finished(self, nodes: list[Node | str]) -> str:
        """Markup with one heading of level 1 and no skips in the document, an id for each heading, and no id twice."""
        for node in within(nodes):
            if node.tag in HEADINGS:
                level = int(node.tag[1])
                if node.attrs.pop("title-of", None) is None and self.tops > 1:
                    level = min(6, level + 1)
                self.level = min(level, self.level + 1)
                node.tag = f"h{self.level}"
                if not node.attrs.get("id"):
                    self.headings += 1
                    node.attrs["id"] = f"h-{self.headings}"
            own = node.attrs.get("id")
            if own and own in self.used:
                n = self.next_of.get(own, 2)
                while f"{own}-{n}" in self.used:
                    n += 1
                self.next_of[own] = n + 1
                node.attrs["id"] = f"{own}-{n}"
                self.warnings.append(f"id {own} used twice; renamed to {own}-{n}")
            if own:
                self.used.add(node.attrs["id"])
        return write(nodes)

    def close(self) -> str:
        return self._finished(self.tail)


def _start(node: Node) -> int:
    try:
        return int(node.attrs.get("start") or 1)
    except ValueError:
        return 1


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, fold, nth = None, None, 0
    rows: list[tuple] = []

    def put(index: int, kind: str, body: str | None, label: str | None = None, merged: bool = False) -> None:
        nonlocal nth
        rows.append((doc, nth, index, kind, body, label, merged))
        nth += 1

    def told(index: int) -> None:
        for warning in fold.warnings:
            put(index, "warning", warning)
        fold.warnings.clear()

    def end(index: int) -> None:
        put(index, "html", fold.close())
        told(index)

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_PIECES.types)], schema=_PIECES)
        rows.clear()
        return out

    last = 0
    for batch in batches:
        html, known = batch.column("html"), batch.column("known")
        size = pc.add(pc.fill_null(pc.binary_length(html), 0), pc.multiply(pc.fill_null(pc.list_value_length(known), 0), _KNOWN_CHARS))
        for start, stop in runs(size.to_numpy(zero_copy_only=False).astype(np.int64)):
            for page in batch.slice(start, stop - start).to_pylist():
                if fold is None or page["doc_id"] != doc:
                    if fold is not None:
                        end(last)
                    doc, nth, fold = page["doc_id"], 0, _Fold(page["title"], int(page["tops"]), set(page["known"] or ()))
                if page["html"] is None:
                    continue
                last = page["page_index"]
                page_id, done, merged = fold.page(last, page["name"], page["label"], page["html"], page["starts"], page["ends"])
                put(last, "page", page_id, page["label"], merged)
                put(last, "html", done)
                told(last)
            yield given()
    if fold is not None:
        end(last)
        yield given()


#: What the fold gives out, in order: finished markup, the id and label of a page, or a warning.
PIECES = "doc_id string, nth int, page_index int, kind string, body string, label string, merged boolean"
_PIECES = pa.schema([("doc_id", pa.string()), ("nth", pa.int32()), ("page_index", pa.int32()), ("kind", pa.string()), ("body", pa.string()), ("label", pa.string()), ("merged", pa.bool_())])
#: What a word that decides on hyphens counts for among the characters of a run of pages.
_KNOWN_CHARS = 16


def _known(built: DataFrame) -> DataFrame:
    """(doc_id, html, stems) -> (doc_id, known): of the words of each document those that begin like one that is broken in it, compounds with a plain hyphen."""
    bare = F.replace(F.lower(F.regexp_replace("html", "<[^>]*>", " ")), F.lit("‐"), F.lit("-"))
    # Written, their size is known when the joins are planned: where they are few, no markup is shuffled to find their documents.
    stems = written(built.select("doc_id", F.explode("stems").alias("stem")).distinct(), "stems")
    # Only documents with a broken word are read for their words.
    words = outline.vocabulary(built.join(stems.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", bare.alias("body")))
    begins = lambda c: F.left(F.col(c), F.lit(1)).alias("_begins")
    both = words.select("doc_id", "word", begins("word")).join(stems.select("doc_id", "stem", begins("stem")), ["doc_id", "_begins"]).filter(F.startswith("word", "stem"))
    return both.groupBy("doc_id").agg(F.collect_set("word").alias("known"))


def pieces(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Pages (markup already in the vocabulary) and (doc_id, title) -> rows (doc_id, nth, page_index, kind, body, label, merged).

    The ``html`` rows of a document, in the order of nth, are its markup; ``page`` rows have the id of a page's mark, its label,
    and whether the page goes on with the block before it; ``warning`` rows say what needs a look.

    A page goes on with the one before if both say so or a word is broken at the edge: the first block of text, within
    whatever holds it, is joined to the last one, past footnotes, with the mark inside; a list also goes on if it starts at
    the number that follows. Else a mark stands between. Headings come out with one of level 1, the title if the pages do not
    have exactly one, without skips and with ids; an id that was used before gets a number.

    Pages that are skipped or blank are left out and do not part the others; a pending blank one gives a warning. A document
    without any page that is built has no rows but warnings. Null flags are false, a null title is the document's id; pages
    that share a number come in any order.
    """
    has = set(pages.columns)
    status = F.col("status") if "status" in has else F.lit("done")
    blank = F.coalesce(F.trim("html"), F.lit("")) == ""
    own = pages.filter(~F.coalesce("skip", F.lit(False)))
    # The document's words, its headings and its pages are read apart: what made the pages runs once, and its result is kept.
    own = written(own.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.coalesce(F.nullif("label", F.lit("")), F.col("page_index").cast("string")).alias("label"), "html",
        F.coalesce("starts_mid_paragraph", F.lit(False)).alias("starts"), F.coalesce("ends_mid_paragraph", F.lit(False)).alias("ends"), status.alias("status"),
        F.regexp_count("html", F.lit(r"(?i)<h1[\s>]")).alias("tops"), F.array_distinct(F.transform(F.regexp_extract_all(F.lower("html"), F.lit(BROKEN_WORDS), 1), lambda x: F.replace(x, F.lit("‐"), F.lit("-")))).alias("stems"),
    ), "pages")
    built = own.filter(~blank)
    facts = built.groupBy("doc_id").agg(F.sum("tops").alias("tops")).join(_known(built), "doc_id", "left")
    if documents is None:
        facts = facts.withColumn("title", F.col("doc_id"))
    else:
        titles = documents.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("title").alias("_title"))
        facts = facts.join(titles, "doc_id", "left").withColumn("title", F.coalesce("_title", "doc_id")).drop("_title")
    paged = built.select("doc_id", "page_index", "label", "html", "starts", "ends", F.concat(F.lit("pg-"), text.slug(F.col("label"))).alias("name"))
    dealt = paged.unionByName(facts, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", F.col("html").isNotNull(), "page_index")
    folded = dealt.select("doc_id", "page_index", "label", "html", "starts", "ends", "title", "tops", "known", "name").mapInArrow(_folded, PIECES)
    pending = own.filter(blank & (F.col("status") == "pending")).select(
        "doc_id", F.lit(-1).alias("nth"), "page_index", F.lit("warning").alias("kind"), F.format_string("page %d: not read yet", "page_index").alias("body"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("merged"),
    )
    return folded.unionByName(pending)


def assemble(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The pieces of each document put together: (doc_id, html, page_ids, n_pages, n_merged, warnings), one row for each document that has pages."""
    listed = pieces(pages, documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "page_index", "kind", "body", "label", "merged"))).alias("_p"))
    of = lambda kind: F.filter("_p", lambda p: p["kind"] == kind)
    return listed.filter(F.exists("_p", lambda p: p["kind"] == "page")).select(
        "doc_id",
        F.array_join(F.transform(of("html"), lambda p: p["body"]), "").alias("html"),
        F.transform(of("page"), lambda p: F.struct(p["body"].alias("id"), p["label"].alias("label"))).alias("page_ids"),
        F.size(of("page")).cast("long").alias("n_pages"),
        F.size(F.filter("_p", lambda p: p["merged"])).cast("long").alias("n_merged"),
        F.transform(of("warning"), lambda p: p["body"]).alias("warnings"),
    )


def page_nav(page_ids: Column) -> Column:
    """Links to the pages."""
    return F.concat(F.lit('<nav role="doc-pagelist"><ol>'), F.array_join(F.transform(page_ids, lambda p: F.format_string('<li><a href="#%s">%s</a></li>', p["id"], text.escaped(p["label"]))), ""), F.lit("</ol></nav>"))


def html_document(title: Column, language: Column, body: Column, nav: Column) -> Column:
    """A whole page of HTML around a document."""
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), language, F.lit('"><head><meta charset="utf-8"><title>'), text.escaped(title), F.lit('</title></head><body><a href="#main">Skip to the text</a>'),
        nav, F.lit('<main id="main">'), body, F.lit("</main></body></html>\n"),
    )


#: A chapter: its markup as XML, its ids, its headings of the upper levels, the marks of its pages, and whether it shows images.
_S = T.StringType()
CHAPTERS = T.ArrayType(
    T.StructType()
    .add("body", _S).add("title", _S).add("ids", T.ArrayType(_S)).add("heads", T.ArrayType(T.StructType().add("level", T.IntegerType()).add("text", _S).add("id", _S)))
    .add("marks", T.ArrayType(T.StructType().add("label", _S).add("id", _S))).add("images", T.BooleanType())
)
#: Levels of headings in a book's contents.
LISTED = 3


def _line(node: Node) -> str:
    """The text of an element in one line; a line break is a space."""
    said, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            said.append(x)
        else:
            said += [" "] if x.tag == "br" else []
            waiting.extend(x.inside[::-1])
    return " ".join("".join(said).split())


def _chapters_of(html: str) -> list[dict]:
    """A document cut before each heading of level 1 or 2 at its top that is not the first thing of a chapter."""
    parts: list[list] = [[]]
    for node in read(html):
        if isinstance(node, Node) and node.tag in ("h1", "h2") and any(isinstance(x, Node) for x in parts[-1]):
            parts.append([])
        parts[-1].append(node if isinstance(node, Node) or not node.strip() else Node("p", {}, [node]))
    out = []
    for nodes in parts:
        inside = list(within(nodes))
        heads = [(int(x.tag[1]), _line(x), x.attrs.get("id", "")) for x in inside if x.tag in HEADINGS]
        for x in inside:
            if x.tag == "img" and x.attrs.get("src", "").startswith("figures/"):
                x.attrs["src"] = "../" + x.attrs["src"]
        out.append({
            "body": write(nodes, xml=True),
            "title": next((said for level, said, own in heads), ""),
            "ids": [x.attrs["id"] for x in inside if x.attrs.get("id")],
            "heads": [{"level": level, "text": said, "id": own} for level, said, own in heads if level <= LISTED and own],
            "marks": [{"label": _line(x), "id": x.attrs["id"]} for x in inside if x.attrs.get("role") == "doc-pagebreak" and x.attrs.get("id")],
            "images": any(x.tag == "img" for x in inside),
        })
    return out


@F.pandas_udf(CHAPTERS)
def _chapters(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return in_parts(html, _chapters_of)


def chapters(documents: DataFrame) -> DataFrame:
    """(doc_id, html) -> (doc_id, nth, file, body, title, ids, heads, marks, images) of the chapters, nth from 1."""
    cut = documents.select("doc_id", F.posexplode(_chapters(F.coalesce("html", F.lit("")))).alias("_nth", "_c"))
    return cut.select("doc_id", (F.col("_nth") + 1).alias("nth"), F.format_string("text/ch%03d.xhtml", F.col("_nth") + 1).alias("file"), "_c.*")


LINK = r'<a\b[^>]*?\shref="#([^"]+)"'


def links_across(cut: DataFrame) -> DataFrame:
    """Chapters -> (doc_id, nth, id, target): the links of a chapter to places that are in another one's file.

    Of places that share an id the first one counts; a link to a place that is nowhere stays as it is.
    """
    places = cut.select("doc_id", "nth", "file", F.explode("ids").alias("id")).groupBy("doc_id", "id").agg(F.min(F.struct("nth", "file")).alias("_at"))
    wanted = cut.select("doc_id", "nth", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LINK), 1))).alias("id"))
    here = cut.select("doc_id", "nth", F.explode("ids").alias("id")).distinct()
    away = wanted.join(here, ["doc_id", "nth", "id"], "left_anti").join(places, ["doc_id", "id"])
    return away.select("doc_id", "nth", "id", F.substring_index("_at.file", "/", -1).alias("target"))


def relinked(cut: DataFrame) -> DataFrame:
    """Chapters whose links across chapters name the file: looked up by a join, put back between the parts of the markup."""
    targets = links_across(cut).groupBy("doc_id", "nth").agg(F.map_from_entries(F.collect_list(F.struct("id", "target"))).alias("_targets"))
    whole = cut.join(targets, ["doc_id", "nth"], "left")
    ids, parts = F.regexp_extract_all("body", F.lit(LINK), 1), F.split("body", r'(?<=<a\b[^<>]{0,2000}\shref=")(?=#[^"])')
    spliced = F.concat(parts[0], F.array_join(F.transform(ids, lambda x, i: F.concat(F.coalesce(F.try_element_at(F.col("_targets"), x), F.lit("")), F.get(parts, i + 1))), ""))
    return whole.withColumn("body", F.when(F.col("_targets").isNull(), F.col("body")).otherwise(spliced)).drop("_targets")


# Names of XML and of the package format, and what a book says of its access.
XHTML, OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops"
CONTAINER = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
FEATURES, PAGE_FEATURES = ("structuralNavigation", "readingOrder", "tableOfContents"), ("pageNavigation", "printPageNumbers", "pageBreakMarkers")
STYLE = "body { line-height: 1.5 }\ntable { border-collapse: collapse }\nth, td { border: 1px solid; padding: 0.2em 0.4em }\nimg { max-width: 100% }\n[role=doc-pagebreak] { color: #555; font-size: 0.8em }\n"


def _page(language: Column, title: Column, style: str, body: Column) -> Column:
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="{XHTML}" xmlns:epub="{OPS}" lang="'), text.escaped(language), F.lit('" xml:lang="'), text.escaped(language),
        F.lit('"><head><title>'), text.escaped(title), F.lit(f'</title><link rel="stylesheet" type="text/css" href="{style}"/></head><body>'), body, F.lit("</body></html>"),
    )


def book_files(assembled: DataFrame, documents: DataFrame | None = None, figures: DataFrame | None = None, modified: str = "2000-01-01T00:00:00Z", numbered: bool = True) -> DataFrame:
    """(doc_id, html) -> (doc_id, name, content): the text files of each document's book.

    Chapters as XML, links between them with the file's name; contents in nested lists, a list of pages and of landmarks; the
    package with metadata, manifest and reading order. documents: (doc_id, title, author, language, source), any of which may
    be null; figures: (doc_id, file, mime), which are named in the manifest. Without ``numbered`` there are no marks of pages.
    Blank markup is a book of one empty chapter; rows must not repeat a doc_id.
    """
    plain = assembled.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("html", F.lit("")).alias("html"))
    plain = plain if numbered else plain.withColumn("html", F.regexp_replace("html", r'<(span|div) role="doc-pagebreak"[^>]*>[^<]*</\1>', ""))
    none = F.lit(None).cast("string")
    has = documents.columns if documents is not None else []
    said = {c: F.col(c) if c in has else none for c in ("title", "author", "language", "source")}
    known = (documents if documents is not None else plain).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(*[F.min(v).alias(c) for c, v in said.items()])
    known = known.select("doc_id", F.coalesce("title", "doc_id").alias("book"), "author", F.coalesce("language", F.lit("en")).alias("language"), "source")
    cut = relinked(chapters(plain)).join(known, "doc_id", "left").withColumns({"book": F.coalesce("book", "doc_id"), "language": F.coalesce("language", F.lit("en"))})
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("book"))
    body = F.concat(F.lit('<section epub:type="bodymatter chapter">'), "body", F.lit("</section>"))
    files = [cut.select("doc_id", F.concat(F.lit("OEBPS/"), "file").alias("name"), _page(F.col("language"), title, "../style.css", body).alias("content"))]
    heads = cut.select("doc_id", "nth", "file", F.posexplode("heads").alias("_at", "h")).select("doc_id", F.struct("nth", "_at").alias("ord"), F.col("h.level").alias("level"), F.col("h.text").alias("text"), F.concat("file", F.lit("#"), "h.id").alias("href"))
    levels = outline.without_skips(heads.select("doc_id", "ord", "level"), seed=0).select("doc_id", "ord", "new_level")
    toc = exports.contents(heads.join(levels, ["doc_id", "ord"]), LISTED)
    pages_ = cut.select("doc_id", "nth", "file", F.posexplode("marks").alias("_at", "m")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "_at", F.col("m.label").alias("label"), F.concat("file", F.lit("#"), "m.id").alias("href")))).alias("_marks"))
    listed = cut.groupBy("doc_id", "book", "author", "language", "source").agg(F.array_sort(F.collect_list(F.struct("nth", "file"))).alias("_c"), F.max("images").alias("_images"))
    book = listed.join(toc, "doc_id", "left").join(pages_, "doc_id", "left")
    if figures is not None:
        shown = figures.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_set(F.struct("file", "mime"))).alias("_figures"))
        book = book.join(shown, "doc_id", "left")
    else:
        book = book.withColumn("_figures", F.lit(None).cast("array<struct<file: string, mime: string>>"))
    first = F.get("_c", F.lit(0))["file"]
    entry = lambda href, label: F.concat(F.lit('<li><a href="'), text.escaped(href), F.lit('">'), text.escaped(label), F.lit("</a></li>"))
    contents_ = F.coalesce("toc", F.concat(F.lit("<ol>"), entry(first, F.col("book")), F.lit("</ol>")))
    page_list = F.concat(F.lit('<nav epub:type="page-list" aria-label="Page list" hidden=""><h2>Page list</h2><ol>'), F.array_join(F.transform("_marks", lambda m: entry(m["href"], m["label"])), ""), F.lit("</ol></nav>"))
    start = F.concat(F.lit('<nav epub:type="landmarks" aria-label="Landmarks" hidden=""><h2>Landmarks</h2><ol><li><a epub:type="bodymatter" href="'), first, F.lit('">Start of content</a></li></ol></nav>'))
    nav = F.concat(F.lit('<nav epub:type="toc" id="toc" aria-label="Table of contents"><h1>Contents</h1>'), contents_, F.lit("</nav>"), F.coalesce(page_list, F.lit("")), start)
    files.append(book.select("doc_id", F.lit("OEBPS/nav.xhtml").alias("name"), _page(F.col("language"), F.col("book"), "style.css", nav).alias("content")))
    meta = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"<dc:{name}>"), text.escaped(value), F.lit(f"</dc:{name}>")))
    feature = lambda names: F.lit("".join(f'<meta property="schema:accessibilityFeature">{n}</meta>' for n in names))
    mode = lambda name: F.lit(f'<meta property="schema:accessMode">{name}</meta>')
    # The same document has the same identifier.
    number = F.regexp_replace(F.md5(F.col("doc_id").cast("binary")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5")
    metadata = F.concat_ws(
        "", F.lit('<dc:identifier id="bookid">urn:uuid:'), number, F.lit("</dc:identifier>"), meta("title", F.col("book")), meta("language", F.col("language")), F.lit(f'<meta property="dcterms:modified">{modified}</meta>'),
        meta("creator", F.col("author")), meta("source", F.col("source")), mode("textual"), F.when(F.col("_images"), mode("visual")), F.lit('<meta property="schema:accessModeSufficient">textual</meta>'),
        feature(FEATURES), F.when(F.col("_marks").isNotNull(), feature(PAGE_FEATURES)), F.when(F.col("_images"), feature(("alternativeText",))), F.lit('<meta property="schema:accessibilityHazard">none</meta>'),
    )
    item = lambda c: F.format_string('<item id="ch%03d" href="%s" media-type="application/xhtml+xml"/>', c["nth"], c["file"])
    picture = lambda f, i: F.concat(F.format_string('<item id="img%d" href="figures/', i + 1), text.escaped(f["file"]), F.lit('" media-type="'), text.escaped(f["mime"]), F.lit('"/>'))
    manifest = F.concat(
        F.lit('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>'),
        F.array_join(F.transform("_c", item), ""), F.coalesce(F.array_join(F.transform("_figures", picture), ""), F.lit("")),
    )
    spine = F.array_join(F.transform("_c", lambda c: F.format_string('<itemref idref="ch%03d"/>', c["nth"])), "")
    package = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid" xml:lang="'), text.escaped(F.col("language")),
        F.lit('" prefix="schema: http://schema.org/"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'), metadata, F.lit("</metadata><manifest>"), manifest, F.lit("</manifest><spine>"), spine, F.lit("</spine></package>"),
    )
    files.append(book.select("doc_id", F.lit("OEBPS/package.opf").alias("name"), package.alias("content")))
    files += [book.select("doc_id", F.lit(name).alias("name"), F.lit(content).alias("content")) for name, content in (("META-INF/container.xml", CONTAINER), ("OEBPS/style.css", STYLE), ("mimetype", "application/epub+zip"))]
    # What XML has not is cut from titles and labels too.
    return reduce(DataFrame.unionByName, files).withColumn("content", F.regexp_replace("content", r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", ""))


@F.pandas_udf(T.BinaryType())
def _zipped(files: pd.Series) -> pd.Series:
    def pack(entries: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for entry in sorted(entries, key=lambda e: (e["name"] != "mimetype", e["name"])):
                how = zipfile.ZIP_STORED if entry["name"] == "mimetype" else zipfile.ZIP_DEFLATED
                z.writestr(zipfile.ZipInfo(entry["name"]), entry["content"], how)
        return out.getvalue()

    return files.map(pack)


def books(files: DataFrame) -> DataFrame:
    """(doc_id, name, content) -> (doc_id, epub): the files in one archive, the kind first and stored. Equal files give equal bytes."""
    return files.groupBy("doc_id").agg(F.collect_list(F.struct("name", "content")).alias("files")).select("doc_id", _zipped("files").alias("epub"))
