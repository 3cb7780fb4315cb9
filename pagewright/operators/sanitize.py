"""Markup reduced to a small vocabulary, as Column expressions on its tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import markup
from pagewright.functions.text import escaped

# The vocabulary.
KEPT = tuple(
    "h1 h2 h3 h4 h5 h6 p ul ol li blockquote table caption thead tbody tfoot tr th td figure figcaption img em strong cite sup sub dl dt dd pre code hr span aside section a br math del ins abbr".split()
)
DROPPED = tuple("script style link meta iframe object embed form input button select".split())
RENAMED = {"b": "strong", "i": "em", "strike": "del", "s": "del"}
ON_ALL = ("id", "lang")
ON_TAG = {
    "a": ("href", "role"), "img": ("src", "alt"), "figure": ("class",), "p": ("class",), "span": ("class",), "ol": ("start", "type"), "th": ("scope", "colspan", "rowspan", "class"),
    "td": ("colspan", "rowspan", "class"), "aside": ("role", "aria-label"), "section": ("aria-label",), "abbr": ("title",), "math": ("display", "xmlns"),
    **{f"h{n}": ("class",) for n in range(1, 7)},
}
CLASSES = ("align-left", "align-center", "align-right", "wrap", "figure-description")
SPAN_CLASS = "small-caps"
LIST_START, LIST_TYPES = r"^-?[0-9]+$", ("1", "a", "A", "i", "I")
ACTIVE_LINK = r"(?i)^\s*(javascript|data):"
REMOVED_IF_HOLLOW = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")


def _literals(values: tuple) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _name(t: Column) -> Column:
    """The tag that a token is written with; '' where it is unwrapped."""
    tag = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair]), t["tag"]), t["tag"])
    plain_span = (tag == "span") & ~F.map_contains_key(t["attrs"], F.lit("lang")) & ~F.array_contains(F.split(F.coalesce(t["attrs"]["class"], F.lit("")), r"\s+"), SPAN_CLASS)
    return (
        F.when(F.array_contains(t["path"], "math"), t["tag"])
        .when((tag == "p") & F.array_contains(t["flags"], "pictured"), "figure")
        .when(tag.isin(*REMOVED_IF_HOLLOW) & F.array_contains(t["flags"], "hollow"), "")
        .when(tag == "div", F.when(F.array_contains(t["flags"], "block") | F.array_contains(t["flags"], "hollow"), "").otherwise("p"))
        .when(plain_span | ~tag.isin(*KEPT), "")
        .otherwise(tag)
    )


def _attributes(t: Column, name: Column) -> Column:
    """The attributes that stay, written out in the order of their names."""
    on_tag = F.coalesce(F.element_at(F.create_map(*[x for tag, names in ON_TAG.items() for x in (F.lit(tag), _literals(names))]), name), F.array().cast("array<string>"))
    classes = F.array_intersect(F.split(F.coalesce(t["attrs"]["class"], F.lit("")), r"\s+"), F.when(name == "span", _literals((SPAN_CLASS,))).otherwise(_literals(CLASSES)))
    value = F.map_filter(
        t["attrs"],
        lambda k, v: (k.isin(*ON_ALL) | F.array_contains(on_tag, k))
        & ~((name == "ol") & (k == "start") & ~F.rlike(v, F.lit(LIST_START)))
        & ~((name == "ol") & (k == "type") & ~v.isin(*LIST_TYPES))
        & ~((k == "href") & F.rlike(v, F.lit(ACTIVE_LINK)))
        & ~((k == "class") & (F.size(classes) == 0)),
    )
    value = F.transform_values(value, lambda k, v: F.when(k == "class", F.array_join(classes, " ")).otherwise(v))
    bare_image = (name == "img") & ~F.map_contains_key(t["attrs"], F.lit("alt"))
    entries = F.concat(F.map_entries(value), F.when(bare_image, F.map_entries(F.create_map(F.lit("alt"), F.lit("")))).otherwise(F.array()))
    # Entries are sorted by their names, which differ.
    written = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    # Most tags have no attributes.
    none = (F.size(t["attrs"]) == 0) & (name != "img")
    return F.when(none | F.array_contains(t["path"], "math"), "").otherwise(F.array_join(written, ""))


def _named(tokens: Column) -> Column:
    """Tokens with the name that each is written with, which is then worked out once."""
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), _name(t).alias("name")))


def _written(named: Column) -> Column:
    t, name = named["token"], named["name"]
    text = reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), t["text"])
    tag = (
        F.when(name == "", "")
        .when(t["kind"] == "end", F.concat(F.lit("</"), name, F.lit(">")))
        .otherwise(F.concat(F.lit("<"), name, _attributes(t, name), F.lit(">")))
    )
    return F.when(t["kind"] == "text", text).otherwise(tag)


def clean(tokens: Column) -> Column:
    """Tokens written in the vocabulary: active content gone with all it holds, other unknown tags gone but for their content."""
    kept = F.filter(
        tokens,
        lambda t: ~F.arrays_overlap(t["path"], _literals(DROPPED)) & ~t["tag"].isin(*DROPPED) & ~F.array_contains(t["flags"], "layout"),
    )
    return F.trim(F.array_join(F.transform(_named(kept), _written), ""))


def _paragraphs(tokens: Column) -> Column:
    """Clean tokens again, with the text and inline tags at the top level gathered in paragraphs.

    Each token in a block is put between two marks. Parted at the marks, the markup is what is loose, a token, what is loose, and
    so on. No markup that is written holds the mark, for no tag's name has a stroke, and texts and values have no angle brackets.
    """
    mark, blocks = F.lit("/>"), sorted(markup.BLOCKS)

    def placed(named: Column) -> Column:
        t, out = named["token"], _written(named)
        outermost = F.coalesce(F.get(t["path"], F.lit(0)), t["tag"])
        return F.when(outermost.isin(*blocks), F.concat(mark, out, mark)).otherwise(out)

    parts = F.split(F.rtrim(F.array_join(F.transform(_named(tokens), placed), "")), mark)
    return F.rtrim(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).when(F.trim(x) == "", "").otherwise(F.concat(F.lit("<p>"), F.ltrim(x), F.lit("</p>")))), ""))


def sanitize(pages: DataFrame, column: str = "html") -> DataFrame:
    """The pages with their markup in the vocabulary. Doing it twice changes nothing.

    Two passes over each page and no shuffle: the second sees the elements that the first has left, so that it removes what
    has become empty and wraps what has come to stand alone.
    """
    # Generators keep the passes apart: the parser cannot take what a lambda makes of its own result.
    once = pages.withColumn("_tokens", markup.tokens(F.col(column))).withColumn(column, F.explode(F.array(clean(F.col("_tokens"))))).drop("_tokens")
    again = once.withColumn("_tokens", markup.tokens(F.col(column)))
    whole = _paragraphs(F.filter("_tokens", lambda t: ~F.array_contains(t["flags"], "layout")))
    return again.withColumn(column, F.explode(F.array(whole))).drop("_tokens")
