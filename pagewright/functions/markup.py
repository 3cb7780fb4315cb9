"""Markup as arrays of tokens.

One small parser turns markup into a balanced row of tokens, each with what it is within; what is done with the tokens
(dropping, renaming, checking, counting) is Column expressions on the array.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B = T.StringType(), T.BooleanType()
#: kind: start, end, void or text. path: the outermost tag around it, then those of MARKED that are around it, each once, so
#: that it is short however deep a page is. flags: what a tag's content is like: ``block`` holds a block directly, ``hollow``
#: shows nothing, ``pictured`` is one image and line breaks; of a text, ``layout`` is white space that only lays markup out.
TOKENS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", _S), T.StructField("tag", _S), T.StructField("attrs", T.MapType(_S, _S)), T.StructField("text", _S), T.StructField("path", T.ArrayType(_S)), T.StructField("flags", T.ArrayType(_S))]
    )
)

# Tags without content, tags that are blocks, and which open ones an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is treated in a way of its own.
MARKED = frozenset("math pre script style link meta iframe object embed form input button select".split())
# Elements that stand on a line of their own in markup that is laid out.
LINES = BLOCKS | frozenset("caption".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}


#: Characters of markup that a task holds parsed at once, about; a row is never parted.
PART_CHARS = 1 << 18


def runs(sizes: np.ndarray, most: int = PART_CHARS) -> Iterator[tuple[int, int]]:
    """The rows in runs (from, to) whose sizes add up to ``most``, about; a run has one row at least, however large."""
    of = np.cumsum(sizes) // most
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1 if len(of) else []
    start = 0
    for end in ends:
        yield start, int(end)
        start = int(end)


def in_parts(batches: Iterator[pd.Series], read: Callable[[str], list[dict]]) -> Iterator[pd.Series]:
    """What read makes of the texts of the batches, given out run by run: what is parsed is many times as large as the text."""
    for batch in batches:
        # Not batch.str: that and the batch hold each other, and stay until the collector comes.
        for start, end in runs(np.fromiter(map(len, batch), np.int64, len(batch))):
            yield batch.iloc[start:end].map(read)


def texts(batches: Iterator[pa.Array]) -> Iterator[pd.Series]:
    """The texts of Arrow batches, run by run: a whole batch of strings may be four times as large as it is in Arrow."""
    for batch in batches:
        for start, end in runs(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
            yield batch.slice(start, end - start).to_pandas()


class _Reader(HTMLParser):
    """Balances tags: what an opening tag implies to be over is closed, what is never opened is not closed.

    How many elements of each tag are open is counted, and what is around a token is kept with its element, so that the
    time for a token does not grow with the depth that it stands at.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[dict] = []
        self.open: list[dict] = []
        self.n_open: Counter[str] = Counter()
        self.around: list[list[str]] = [[]]

    def _put(self, kind: str, tag: str, attrs: dict, text: str) -> dict:
        token = {"kind": kind, "tag": tag, "attrs": attrs, "text": text, "path": self.around[-1], "flags": []}
        self.tokens.append(token)
        return token

    def _open(self, tag: str, attrs: dict) -> None:
        self.open.append(self._put("start", tag, attrs, ""))
        self.n_open[tag] += 1
        path = self.around[-1]
        self.around.append([*path, tag] if not path or tag in MARKED and tag not in path[1:] else path)

    def _close(self) -> None:
        start = self.open.pop()
        self.n_open[start["tag"]] -= 1
        self.around.pop()
        self._put("end", start["tag"], start["attrs"], "")["flags"] = start["flags"]

    def _end_paragraph(self) -> None:
        """A block ends the paragraph that it stands in, unless another block holds it within."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == "p":
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k]["tag"] in BLOCKS:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag in BLOCKS and self.n_open["p"]:
            self._end_paragraph()
        over = ENDS.get(tag, frozenset())
        if any(self.n_open[x] for x in over):
            until = _LIMITS.get(tag, frozenset())
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] in until:
                    break
                if self.open[i]["tag"] in over:
                    while len(self.open) > i:
                        self._close()
        if tag in VOID:
            self._put("void", tag, values, "")
        else:
            self._open(tag, values)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.n_open[tag]:
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        self._put("text", "", {}, data)


class _Seen:
    """What is in an element: known when it closes, and then a part of what is in the one around it."""

    __slots__ = ("token", "block", "images", "shown", "other", "inside")

    def __init__(self, token: dict | None) -> None:
        self.token, self.block, self.images, self.shown, self.other = token, False, 0, False, False
        self.inside: list[dict] = []

    def add(self, token: dict) -> None:
        tag = token["tag"]
        self.block |= tag in BLOCKS
        self.images += tag == "img"
        self.shown |= tag in ("img", "br", "math")
        self.other |= tag not in ("img", "br")
        self.inside.append(token)


def _lay_out(seen: _Seen) -> None:
    """White space goes from the edges of an element that holds lines and from beside the lines; between inline elements it is text."""
    if not any(x["tag"] in LINES for x in seen.inside):
        return
    for i, x in enumerate(seen.inside):
        if x["kind"] == "text":
            before, after = (seen.inside[k]["tag"] if 0 <= k < len(seen.inside) else None for k in (i - 1, i + 1))
            x["text"] = x["text"].lstrip() if before is None or before in LINES else x["text"]
            x["text"] = x["text"].rstrip() if after is None or after in LINES else x["text"]
            if not x["text"]:
                x["flags"].append("layout")


def _flag(tokens: list[dict]) -> None:
    """Sets the flags of elements from their content, and takes the white space out that only lays markup out."""
    stack = [_Seen(None)]
    for token in tokens:
        if token["kind"] == "end":
            seen = stack.pop()
            seen.token["flags"][:] = [name for name, holds in (("block", seen.block), ("hollow", not seen.shown), ("pictured", seen.images == 1 and not seen.other)) if holds]
            if "pre" not in (seen.token["tag"], *seen.token["path"]):
                _lay_out(seen)
            outer = stack[-1]
            outer.images, outer.shown, outer.other = outer.images + seen.images, outer.shown or seen.shown, outer.other or seen.other
        elif token["kind"] == "text":
            if token["text"].strip():
                stack[-1].shown = stack[-1].other = True
            stack[-1].inside.append(token)
        else:
            stack[-1].add(token)
            if token["kind"] == "start":
                stack.append(_Seen(token))
    _lay_out(stack[0])


def _read(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    while reader.open:
        reader._close()
    return reader.tokens


def read_tokens(html: str | None) -> list[dict]:
    tokens = _read(html)
    _flag(tokens)
    return tokens


_TOKENS = pa.list_(pa.struct([("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.list_(pa.string())), ("flags", pa.list_(pa.string()))]))


@F.arrow_udf(TOKENS)
def _tokens(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in in_parts(texts(html), read_tokens):
        yield pa.array(part, _TOKENS)


def tokens(html: Column) -> Column:
    """The tokens of markup; null has none."""
    return _tokens(F.coalesce(html, F.lit("")))


def text_of(tokens_: Column) -> Column:
    """The text between the tags in one line; script and style hold none, and pieces are a space apart."""
    shown = F.filter(tokens_, lambda t: (t["kind"] == "text") & ~F.arrays_overlap(t["path"], F.array(F.lit("script"), F.lit("style"))))
    return F.trim(F.regexp_replace(F.array_join(F.transform(shown, lambda t: t["text"]), " "), r"\s+", " "))


#: What checks ask of an element: the start of its text and whether that is blank, the images and header cells in it, and the
#: start of its first header cell without a scope. Only READ elements have a text.
ELEMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("tag", _S), T.StructField("attrs", T.MapType(_S, _S)), T.StructField("text", _S), T.StructField("blank", _B), T.StructField("images", T.IntegerType()), T.StructField("headers", T.IntegerType()), T.StructField("unscoped", _S)]
    )
)
READ = frozenset("h1 h2 h3 h4 h5 h6 a table th title".split())
#: Characters of an element's and of a header cell's text that are told.
TOLD, TOLD_HEADER = 60, 40


def read_elements(html: str | None) -> list[dict]:
    """The elements of markup in the order of their start tags. What an element adds to those around it is added when it closes."""
    found: list[dict] = []
    # The elements that are open, each with as much of its text as is told and whether that is all blank.
    stack: list[tuple[dict, list]] = [({"images": 0, "headers": 0, "unscoped": None, "tag": ""}, ["", True])]
    for token in _read(html):
        kind, tag = token["kind"], token["tag"]
        if kind == "text":
            said = stack[-1][1]
            said[0], said[1] = (said[0] + token["text"])[:TOLD], said[1] and not token["text"].strip()
        elif kind == "end":
            element, (text, blank) = stack.pop()
            outer, said = stack[-1]
            if element["tag"] in READ:
                element["text"], element["blank"] = text, blank
            if element["unscoped"] is None and tag == "th" and not element["attrs"].get("scope"):
                own = text[:TOLD_HEADER]
            else:
                own = element["unscoped"]
            outer["unscoped"] = own if outer["unscoped"] is None else outer["unscoped"]
            outer["images"] += element["images"] + (tag == "img")
            outer["headers"] += element["headers"] + (tag == "th")
            said[0], said[1] = (said[0] + text)[:TOLD], said[1] and blank
        else:
            element = {"tag": tag, "attrs": token["attrs"], "text": "", "blank": True, "images": 0, "headers": 0, "unscoped": None}
            found.append(element)
            if kind == "start":
                stack.append((element, ["", True]))
            else:
                stack[-1][0]["images"] += tag == "img"
    return found


_ELEMENTS = pa.list_(pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("blank", pa.bool_()), ("images", pa.int32()), ("headers", pa.int32()), ("unscoped", pa.string())]))


@F.arrow_udf(ELEMENTS)
def _elements(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in in_parts(texts(html), read_elements):
        yield pa.array(part, _ELEMENTS)


def elements(html: Column) -> Column:
    """The elements of markup; null has none."""
    return _elements(F.coalesce(html, F.lit("")))
