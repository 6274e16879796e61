"""Rendering of blocks as Markdown.

Blocks: doc_id, page, block_no, type (heading, paragraph, listItem or raw), level, lines array<string>, raw string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    """A backslash before a start that Markdown would read as a mark, and before every backtick."""
    return F.replace(F.regexp_replace(text, r"\A(?=[#>*+-]|[0-9]+\.)", r"\\"), F.lit("`"), F.lit("\\`"))


def render_block(kind: Column, level: Column, text: Column, raw: Column) -> Column:
    """A block's Markdown with the line feed at its end; null for unknown types."""
    body = escape(text)
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body, F.lit("\n")))
        .when(kind == "listItem", F.concat(F.lit("- "), body, F.lit("\n")))
        .when(kind == "paragraph", F.concat(body, F.lit("\n")))
        .when(kind == "raw", F.when(raw.endswith("\n"), raw).otherwise(F.concat(raw, F.lit("\n"))))
    )


def render_blocks(blocks: Column) -> Column:
    """The Markdown of an array of block structs, with blank lines between them; no shuffle, as a document is one row."""
    return F.array_join(F.transform(blocks, lambda b: render_block(b["type"], b["level"], F.array_join(b["lines"], "\n"), b["raw"])), "\n")


def render_documents(blocks: DataFrame) -> DataFrame:
    """One Markdown text for each doc_id, its blocks in the order of page and block_no, with blank lines between."""
    text = F.array_join("lines", "\n")
    out = blocks.select("doc_id", F.struct("page", "block_no", render_block(F.col("type"), F.col("level"), text, F.col("raw")).alias("md")).alias("b"))
    return out.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("b"))["md"], "\n").alias("markdown"))
