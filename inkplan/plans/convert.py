"""Whole conversions: inputs to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..operators.extract import PARSERS, extracted
from ..operators.extract_text import text_block_array
from ..operators.jobs import job_table
from ..operators.layout import doc_stats, layout_blocks
from ..operators.render import render_blocks, render_documents
from ..sources.files import decoded
from ..sources.pdf import Reader, read_pages, scan_spans


def text_markdown(docs: DataFrame, plain: bool = False) -> DataFrame:
    """doc_id, markdown of ``docs(doc_id, text)``; a blank or null text gives no row. Nothing is shuffled.

    Texts that look like Markdown are taken as such unless they are plain.
    """
    blocks = docs.select("doc_id", text_block_array(F.col("text"), plain=plain).alias("blocks"))
    return blocks.where(F.size("blocks") > 0).select("doc_id", render_blocks(F.col("blocks")).alias("markdown"))


def spans_markdown(spans: DataFrame, pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    return render_documents(layout_blocks(spans, doc_stats(pages, config), config))


def convert_pdf(inputs: DataFrame, config: LayoutConfig = LayoutConfig(), reader: Reader = read_pages) -> DataFrame:
    """doc_id, name, format, markdown, item_count, failed_pages, body_font_size, error_type, error_message of ``inputs(doc_id, name, format, content)``.

    Statistics and layout both need what the reader gives: the files are read once, into a cache that Spark can spill
    and recompute. Names and formats come along with what is read, so that the inputs aren't made once more for them.
    """
    spans, pages, opened = scan_spans(inputs, reader, StorageLevel.DISK_ONLY)
    stats = doc_stats(pages, config)
    scanned = F.col("error_type").isNull() & F.coalesce("likely_scanned", F.lit(False))
    found = opened.join(stats.select("doc_id", "likely_scanned", "body_font_size"), "doc_id", "left").join(render_documents(layout_blocks(spans, stats, config)), "doc_id", "left")
    return found.select(
        "doc_id", "name", "format", "markdown", F.col("page_count").alias("item_count"), "failed_pages", "body_font_size", F.when(scanned, "noText").otherwise(F.col("error_type")).alias("error_type"),
        F.when(scanned, "The document looks scanned; without text recognition there is nothing to convert.").otherwise(F.col("error_message")).alias("error_message"),
    )


def convert(inputs: DataFrame, config: LayoutConfig = LayoutConfig(), strict: bool = False, pdf_reader: Reader = read_pages, parsers: dict[str, Callable] = PARSERS) -> DataFrame:
    """jobs of ``inputs(doc_id, name, content, format)`` in all formats, a row each.

    Only PDF files are shuffled, by document and page; all others are converted where they are read. Inputs with null
    content are unsupported.
    """
    rows = extracted(decoded(inputs.where("format is null or format <> 'pdf' or content is null"), strict), parsers)
    rest = rows.select("doc_id", "name", "format", render_blocks(F.col("blocks")).alias("markdown"), "item_count", F.array().cast("array<int>").alias("failed_pages"), F.lit(None).cast("double").alias("body_font_size"), "error_type", "error_message")
    return job_table(rest.unionByName(convert_pdf(inputs.where("format = 'pdf' and content is not null"), config, pdf_reader)))


def convert_again(jobs: DataFrame, inputs: DataFrame, config: LayoutConfig = LayoutConfig(), **how) -> DataFrame:
    """jobs with those that are not done converted anew from their inputs, with the keywords of ``convert``; the others stay."""
    done = jobs.where("status = 'done'")
    return done.unionByName(convert(inputs.join(done.select("doc_id"), "doc_id", "left_anti"), config, **how))
