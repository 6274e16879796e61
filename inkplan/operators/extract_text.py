"""Plain text and Markdown to blocks, in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, is_blank, trim

_MARKS = r"\A(#{1,6} |[-*+] |[0-9]+\. |> |```)|\A\|.*\|\z"


def looks_like_markdown(text: Column) -> Column:
    """Whether a line has a heading's, list's, quote's or fence's start, or is a table row."""
    return ~is_blank(text) & F.exists(F.split(text, "\n"), lambda x: x.rlike(_MARKS))


def is_markdown_name(name: Column) -> Column:
    lower = F.lower(name)
    return lower.endswith(".md") | lower.endswith(".markdown")


def paragraphs(text: Column) -> Column:
    """The text's paragraphs, as blank lines part them, trimmed, without empty ones."""
    parts = F.split(text, rf"\r?\n{SPACE_CLASS}*\r?\n")
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def text_block_array(text: Column, name: Column | None = None, plain: bool = False) -> Column:
    """The blocks of a text as an array of structs (type, level, lines, raw): one raw block of Markdown, or the paragraphs.

    A blank text has none; for a null text the array is null. A plain text is paragraphs, whatever it looks like.
    """
    md = F.lit(False) if plain else looks_like_markdown(text)
    if name is not None:
        md = md | F.coalesce(is_markdown_name(name), F.lit(False))
    nothing = F.lit(None)
    raw = F.struct(F.lit("raw").alias("type"), F.lit(0).alias("level"), nothing.cast("array<string>").alias("lines"), text.alias("raw"))
    one = lambda p: F.struct(F.lit("paragraph").alias("type"), F.lit(0).alias("level"), F.array(p).alias("lines"), nothing.cast("string").alias("raw"))
    return F.when(md & ~is_blank(text), F.array(raw)).otherwise(F.transform(paragraphs(text), one))


def text_blocks(docs: DataFrame, plain: bool = False) -> DataFrame:
    """Blocks of ``docs(doc_id, text[, name])``, a row each; those of plain texts are paragraphs, whatever they look like."""
    name = F.col("name") if "name" in docs.columns else None
    each = docs.select("doc_id", F.posexplode(text_block_array(F.col("text"), name, plain)).alias("block_no", "b"))
    return each.select("doc_id", F.lit(0).alias("page"), "block_no", "b.*")
