"""Markup as small trees, for folds over a document that look into its blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pagewright.functions.markup import VOID, _Reader


class Node:
    """An element: its tag, attributes, and what is inside, nodes and texts."""

    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, inside: list | None = None) -> None:
        self.tag, self.attrs, self.inside = tag, attrs or {}, inside if inside is not None else []

    def elements(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]


def read(markup: str | None) -> list[Node | str]:
    """The top of balanced markup: nodes and the texts between them."""
    reader = _Reader()
    reader.feed(markup or "")
    reader.close()
    while reader.open:
        reader._close()
    top: list[Node | str] = []
    into = [top]
    for token in reader.tokens:
        if token["kind"] == "text":
            if into[-1] and isinstance(into[-1][-1], str):
                into[-1][-1] += token["text"]
            else:
                into[-1].append(token["text"])
        elif token["kind"] == "end":
            into.pop()
        else:
            # The reader goes through the attributes from the last one, so that the first of a name counts.
            node = Node(token["tag"], dict(reversed(token["attrs"].items())))
            into[-1].append(node)
            if token["kind"] == "start":
                into.append(node.inside)
    return top


def within(nodes: list[Node | str]) -> Iterator[Node]:
    """All elements in the order of their start tags."""
    waiting = nodes[::-1]
    while waiting:
        x = waiting.pop()
        if isinstance(x, Node):
            yield x
            waiting.extend(x.inside[::-1])


# What a reading system is told of elements with these roles, and characters that XML has not.
EPUB_TYPES = {"doc-pagebreak": "pagebreak", "doc-footnote": "footnote", "doc-noteref": "noteref", "doc-backlink": "backlink"}
NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")


def write(nodes: list[Node | str], xml: bool = False) -> str:
    """Markup whose texts and attribute values hold no angle brackets, so that a tag ends at the next one.

    As XML, void elements are closed, roles have their epub:type, and what XML cannot hold is left out.
    """
    out: list[str] = []
    waiting: list = nodes[::-1]
    while waiting:
        x = waiting.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(entities.escape(x, quote=False))
        else:
            attrs = x.attrs
            if xml:
                attrs = {k: v for k, v in attrs.items() if NAME.fullmatch(k) and k != "xmlns"}
                if x.tag == "math":
                    attrs["xmlns"] = "http://www.w3.org/1998/Math/MathML"
                if attrs.get("role") in EPUB_TYPES:
                    attrs["epub:type"] = EPUB_TYPES[attrs["role"]]
            void = x.tag in VOID
            out.append("<" + x.tag + "".join(f' {k}="{entities.escape(v)}"' for k, v in attrs.items()) + ("/>" if void and xml else ">"))
            if not void:
                waiting.append((f"</{x.tag}>",))
                waiting.extend(x.inside[::-1])
    written = "".join(out)
    return NOT_XML.sub("", written) if xml else written
