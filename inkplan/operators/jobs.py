"""Conversion jobs: status, roll-ups and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_name

#: What an error says if the conversion gave no message.
ERROR_TEXTS = {
    "encrypted": "This file is protected.",
    "noText": "No text was found in this file.",
    "corrupt": "This file could not be read.",
    "unsupported": "This format is not supported.",
}
OTHER_ERROR = "The conversion failed."


def progress_fraction(page: Column, total: Column) -> Column:
    """From 0 to 1; null without a total."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), page / total)))


def error_text(error_type: Column, message: Column) -> Column:
    fixed = F.coalesce(F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair])[error_type], F.lit(OTHER_ERROR))
    return F.when(F.length(message) > 0, message).otherwise(fixed)


def status_summary(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for ``jobs(status, page, total)``, or one for each batch by the columns ``by``: counts by state, mean
    progress of running ones, and the batch's state."""
    n = lambda s: F.count_if(F.col("status") == s)
    running = F.col("status") == "running"
    sums = jobs.groupBy(*by).agg(
        F.count("*").alias("all_jobs"), F.count_if(F.col("status") != "queued").alias("completed"), n("done").alias("done"), n("failed").alias("failed"),
        n("running").alias("running"), F.avg(F.when(running, progress_fraction(F.col("page"), F.col("total")))).alias("progress"),
        F.coalesce(F.bool_and(F.col("status") != "queued"), F.lit(True)).alias("all_started"),
    )
    state = F.when(F.col("running") > 0, "processing").when(F.col("all_jobs") == 0, "ready").when(F.col("all_started"), "done").otherwise("loaded")
    return sums.withColumn("state", state)


def batch_warning(jobs: DataFrame, many: int = 10, long: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each batch by the columns ``by``: whether there are more jobs than ``many`` (large_batch), else
    the first job by seq with more pages than ``long`` (large_file, name)."""
    sums = jobs.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("name", F.when(F.col("page_count") > long, F.col("seq"))).alias("name"), F.count_if(F.col("page_count") > long).alias("long"))
    kind = F.when(F.col("n") > many, "large_batch").when(F.col("long") > 0, "large_file")
    return sums.select(*by, kind.alias("warning"), F.when(kind == "large_file", F.col("name")).alias("name"), F.col("n").alias("all_jobs"))


def job_table(results: DataFrame) -> DataFrame:
    """jobs of ``results(doc_id, name, format, markdown, item_count, failed_pages, body_font_size, error_type,
    error_message)``: doc_id, name, format, status, page_count, failed_pages (from 1), body_font_size, error_type,
    error_message, output_name, content.

    One with an error is failed and has no content; one with failed pages is done with the others.
    """
    failed = F.col("error_type").isNotNull()
    return results.select(
        "doc_id", "name", "format", F.when(failed, "failed").otherwise("done").alias("status"), F.coalesce("item_count", F.lit(0)).alias("page_count"), "failed_pages", "body_font_size", "error_type",
        F.when(failed, error_text(F.col("error_type"), F.col("error_message"))).alias("error_message"), output_name(F.col("name")).alias("output_name"),
        F.when(~failed, F.coalesce("markdown", F.lit(""))).alias("content"),
    )
