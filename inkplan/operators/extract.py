"""Files of the supported formats to blocks, and what could not be converted.

Blocks: doc_id, page, block_no, type, level, lines, raw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse, parse_html
from .extract_text import text_block_array
from .render import render_blocks

_BLOCK = pa.struct([("type", pa.string()), ("level", pa.int32()), ("lines", pa.list_(pa.string())), ("raw", pa.string())])
_OUTCOME = [("blocks", pa.list_(_BLOCK)), ("item_count", pa.int32()), ("error_type", pa.string()), ("error_message", pa.string())]
_OUTCOME_SQL = "blocks array<struct<type:string,level:int,lines:array<string>,raw:string>>, item_count int, error_type string, error_message string"
_KEYS = "doc_id long, name string, format string"

#: Formats that a parser turns into blocks. Plain text and Markdown are done by column functions.
PARSERS: dict[str, Callable[[str], tuple[list[parse.Block], int]]] = {
    "csv": parse.csv_blocks,
    "json": parse.json_blocks,
    "xml": parse.xml_blocks,
    "html": parse_html.html_blocks,
}


def _keys(docs: DataFrame) -> list[Column]:
    name = F.col("name") if "name" in docs.columns else F.lit(None)
    return [F.col("doc_id").cast("long").alias("doc_id"), name.cast("string").alias("name"), F.col("format").cast("string").alias("format")]


def _parsed(docs: DataFrame, parsers: dict[str, Callable]) -> DataFrame:
    """``docs(doc_id[, name], format, text)``, a row each, with blocks, item_count, error_type and error_message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: tuple[list, ...] = ([], [], [], [])
                for fmt, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    try:
                        if text is None:
                            raise parse.Unconvertible("corrupt", f"Could not read the {fmt.upper()} file.")
                        blocks, count = parsers[fmt](text)
                        row = ([dict(zip(("type", "level", "lines", "raw"), b, strict=True)) for b in blocks], count, None, None)
                    except parse.Unconvertible as e:
                        row = ([], 0, e.kind, str(e))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                made = [pa.array(c, t) for c, (_, t) in zip(out, _OUTCOME, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *made], ["doc_id", "name", "format", *(n for n, _ in _OUTCOME)])

    return docs.select(*_keys(docs), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{_KEYS}, {_OUTCOME_SQL}")


def extracted(docs: DataFrame, parsers: dict[str, Callable] = PARSERS) -> DataFrame:
    """``docs(doc_id[, name], format, text)`` in any format but PDF, a row each: blocks, item_count, error_type, error_message.

    A document stays in one row, so nothing is shuffled. Errors: unsupported (another format, or null; where docs have
    content, also null content), corrupt (a null
    text or one that does not parse), noText. A blank text or Markdown file has no blocks and no error. ``parsers`` may
    have functions for further formats.
    """
    known = F.coalesce(F.col("format"), F.lit("unknown"))
    if "content" in docs.columns:
        known = F.when(F.col("content").isNull(), "missing").otherwise(known)
    plain, text, name = known.isin("text", "markdown"), F.col("text").cast("string"), F.col("name") if "name" in docs.columns else None
    blocks, unread = F.when(plain, text_block_array(text, name)), plain & text.isNull()
    # texts and what is not supported come from one scan of docs, as these may be costly to make
    others = docs.where(~known.isin(*parsers, "pdf")).select(
        *_keys(docs), F.coalesce(blocks, F.array()).alias("blocks"), F.greatest(F.coalesce(F.size(blocks), F.lit(0)), F.lit(0)).alias("item_count"),
        F.when(~plain, "unsupported").when(unread, "corrupt").alias("error_type"), F.when(~plain, "This format is not supported.").when(unread, "Could not read the text file.").alias("error_message"),
    )
    return others.unionByName(_parsed(docs.where(known.isin(*parsers)), parsers))


def _of_format(docs: DataFrame, fmt: str) -> DataFrame:
    return _parsed(docs.select("doc_id", F.lit(fmt).alias("format"), "text"), PARSERS)


def parsed_blocks(docs: DataFrame, fmt: str) -> DataFrame:
    """The blocks of ``docs(doc_id, text)``, all of one format, a row each; documents that can't be converted have none."""
    return _of_format(docs, fmt).select("doc_id", F.lit(0).alias("page"), F.posexplode("blocks").alias("block_no", "b")).select("doc_id", "page", "block_no", "b.*")


def parsed_outcomes(docs: DataFrame, fmt: str) -> DataFrame:
    """doc_id, item_count, error_type, error_message of ``docs(doc_id, text)``, all of one format."""
    return _of_format(docs, fmt).select("doc_id", "item_count", "error_type", "error_message")


def parsed_markdown(docs: DataFrame, fmt: str) -> DataFrame:
    """doc_id, markdown of ``docs(doc_id, text)``, all of one format; documents without blocks have no row."""
    return _of_format(docs, fmt).where(F.size("blocks") > 0).select("doc_id", render_blocks(F.col("blocks")).alias("markdown"))
