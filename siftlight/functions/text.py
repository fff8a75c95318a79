"""Column functions on text: white space, sentences, tokens, hashes, previews, wrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that the regex class leaves out.
WHITE = r"(?U)[\s\x1c-\x1f]+"
#: Between sentences: after an end mark, before an upper-case letter or digit that may be quoted.
BREAK = r"""(?<=[.!?])\s+(?=["'(\[]?[A-Z0-9])"""


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, WHITE, " "), F.lit(" "))


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text; none of an empty one."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, BREAK, -1))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def word_tokens(text: Column) -> Column:
    """Words of two or more word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def content_hash(text: Column, model_id: str) -> Column:
    """SHA-256 of the model's id, a NUL, and the text."""
    return F.sha2(F.concat(F.lit(model_id), F.lit("\0"), text).cast("binary"), 256)


def preview(text: Column, width: int = 160) -> Column:
    """The first characters of the collapsed text, marked if the raw text is longer."""
    return F.concat(F.substring(collapse(text), 1, width), F.when(F.length(text) > width, "...").otherwise(""))


def wrap(text: Column, width: int = 60, mark: str = "<br>") -> Column:
    """Lines of words joined by ``mark``: a word that would reach past ``width`` starts a
    line, and so does a first word of that width, after an empty line."""
    flat = collapse(text)
    line = rf"(?s)(\S{{{width + 1},}}|\S.{{0,{width - 1}}}(?= |$))(?: |$)"
    lines = F.rtrim(F.regexp_replace(flat, line, "$1\n"), F.lit("\n"))
    first = F.when(F.length(F.substring_index(flat, " ", 1)) >= width, "\n").otherwise("")
    return F.replace(F.concat(first, lines), F.lit("\n"), F.lit(mark))
