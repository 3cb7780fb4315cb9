"""Text rules as Column expressions; a Python function only where Spark has no Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A reply that has one of these, in lower case, is a refusal.
REFUSALS = (
    "i can't help with", "i cannot help with", "i can't assist with", "i cannot assist with",
    "i'm not able to help with", "i am not able to help with", "i'm unable to help with",
    "i can't transcribe", "i cannot transcribe", "i can't reproduce", "i cannot reproduce",
    "i can't provide", "i cannot provide", "i won't be able to", "i'm sorry, but i can't",
    "i'm sorry, but i cannot", "unable to comply", "against my guidelines", "copyright",
    "copyrighted material", "copyrighted work", "intellectual property",
)
LONGEST_REFUSAL = 1500

# Titles that software wrote by itself.
PROGRAM_TITLE = r"(?i)^(microsoft\s+)?(word|excel|powerpoint|publisher|office)\s+-\s+"
FILE_TITLE = r"(?i)\.(docx?|rtf|odt|wpd|pptx?|xlsx?|pdf|txt|html?|tiff?|jpe?g|png|indd|qxd|e?ps)$"
ID_TITLE = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-|[0-9a-f]{16}"
PLACEHOLDER_TITLE = r"(?i)^(untitled|no title|title|none|unknown|(scanned |microsoft word )?(document|scan|image|page|presentation)) ?[0-9]*$"
# Accounts and placeholders that are not authors.
MACHINE_AUTHOR = (
    r"(?i)^(svc|service)[-_.]|^(administrator|admin|user|owner|default|unknown|none|author|scanner|windows user|microsoft office user|registered user)$"
)
# What a language tag looks like, and the marks of a dot leader.
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$"
LEADER = "[.․‥…]"
SHORTEST_PREFIX = 4


def locate_key(text: Column) -> Column:
    """The key under which words are located: ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def keys_match(a: Column, b: Column) -> Column:
    """Two keys match if equal, or if the shorter one, of four characters or more, begins the longer one; empty ones never do."""
    begins = (F.least(F.length(a), F.length(b)) >= SHORTEST_PREFIX) & (F.startswith(a, b) | F.startswith(b, a))
    return (a != "") & (b != "") & ((a == b) | begins)


def n_words(text: Column) -> Column:
    """Runs of letters, digits and underscores; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0)).cast("long")


def n_tokens(text: Column) -> Column:
    """Runs without white space, tags included; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_leaders(html: Column) -> Column:
    """Runs of five or more leader marks, white space among them, become one space."""
    return F.regexp_replace(html, rf"(?:\s*{LEADER}){{5,}}\s*", " ")


def visible_text(html: Column) -> Column:
    """The text between the tags, in one line; script and style content and comments are not text."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return one_line(F.regexp_replace(bare, r"<[^>]*>", " "))


def heading_text(inner: Column) -> Column:
    """The text of a heading: a line break is a space."""
    return one_line(F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\s*/?>", " "), r"<[^>]*>", ""))


def escaped(text: Column) -> Column:
    """Text as it stands in markup."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def table_of(reply: Column) -> Column:
    """From the first table tag of a reply to its last end tag; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?is)<table\b.*</table\s*>", 0), F.lit(""))


def api_root(url: Column) -> Column:
    """The root of a chat endpoint, whether it was given with the endpoint's path or not."""
    root = F.regexp_replace(F.trim(url), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(root, r"(/chat)?/completions$", ""), r"/+$", "")


def joined_notes(*notes: Column) -> Column:
    """The notes that are not blank, with a bar between."""
    return F.concat_ws(" | ", *[F.when(F.trim(n) != "", n) for n in notes])


def is_refusal(reply: Column) -> Column:
    """Short prose in which a model refuses."""
    text = F.lower(F.trim(F.coalesce(reply, F.lit(""))))
    return (text != "") & (F.length(text) <= LONGEST_REFUSAL) & reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in REFUSALS])


def usable_title(title: Column) -> Column:
    """A title as stored in a file, or '' where software made it up."""
    text = F.trim(F.coalesce(title, F.lit("")))
    made_up = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in (PROGRAM_TITLE, FILE_TITLE, ID_TITLE, PLACEHOLDER_TITLE)])
    return F.when(made_up | (F.contains(text, F.lit("_")) & ~F.contains(text, F.lit(" "))), "").otherwise(text)


def usable_author(author: Column) -> Column:
    """An author as stored in a file, or '' where it is an account."""
    text = F.trim(F.coalesce(author, F.lit("")))
    return F.when(F.rlike(text, F.lit(MACHINE_AUTHOR)), "").otherwise(text)


def is_language(tag: Column) -> Column:
    return F.coalesce(F.rlike(tag, F.lit(LANGUAGE_TAG)), F.lit(False))


def clean_prompt(text: Column) -> Column:
    """One kind of line end, no byte order mark, one line end at the end; '' if blank."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n"), F.lit(" \n\t"))
    return F.when(bare != "", F.concat(bare, F.lit("\n"))).otherwise("")


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(text: Column, longest: int = 80) -> Column:
    """A name for files and ids: letters without their accents, the rest hyphens; 'document' if nothing is left."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(_ascii(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(F.left(bare, F.lit(longest)), F.lit("")), F.lit("document"))


def document_id(stem: Column, fingerprint: Column) -> Column:
    return F.concat(F.regexp_replace(F.left(slug(stem), F.lit(60)), "-+$", ""), F.lit("-"), F.left(fingerprint, F.lit(8)))


_NOT_LETTERS = re.compile(r"[\W_]+")


def fold_key(word: str) -> str:
    """The key under which words are compared: compatibility forms and case folded, accents kept."""
    return _NOT_LETTERS.sub("", unicodedata.normalize("NFKC", word).casefold())


def broken_word(tail: Column, lead: Column) -> tuple[Column, Column]:
    """The parts of the word that a tail and a lead have between them, in lower case and without the mark at the end of the tail."""
    stem = F.substr(tail, F.lit(1), F.length(tail) - 1)
    # A run is looked for from its start only.
    return F.lower(F.regexp_extract(stem, r"(?<![\p{L}\p{N}‐-])([\p{L}\p{N}‐-]++)$", 1)), F.lower(F.regexp_extract(lead, r"^([\p{L}\p{N}]++)", 1))


def knit(tail: Column, lead: Column, vocabulary: Column, parts: tuple[Column, Column] | None = None) -> Column:
    """How a word broken at a page's end goes on: the tail as it stands before the lead, null if the two are separate words.

    A soft hyphen always goes. A hyphen stays before a capital or a digit, and, unless the document spells the word without
    it, after a stem that is a compound already and where the document spells the compound with it; else it goes. Where there
    are many words, parts are columns that hold their ``broken_word``, so that it is worked out once.
    """
    before, after = parts or broken_word(tail, lead)
    stem, mark = F.substr(tail, F.lit(1), F.length(tail) - 1), F.right(tail, F.lit(1))
    joined = F.array_contains(vocabulary, F.concat(before, after))
    kept = ~joined & (F.contains(before, F.lit("-")) | F.array_contains(vocabulary, F.concat(before, F.lit("-"), after)))
    return (
        F.when(~mark.isin("-", "‐", "­") | (after == ""), F.lit(None).cast("string"))
        .when(mark == "­", stem)
        .when(~F.rlike(lead, F.lit(r"^\p{Ll}")) | F.coalesce(kept, F.lit(False)), tail)
        .otherwise(stem)
    )
