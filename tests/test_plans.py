"""Shapes of physical plans that decide how the operators scale."""

import re

from pyspark.sql import functions as F

from inkplan.operators import extract, layout
from inkplan.plans import queries
from inkplan.plans.convert import text_markdown


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


def test_documents_stay_where_they_are_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert shuffles(text_markdown(docs)) == 0
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(text_markdown(docs)))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    assert shuffles(extract.parsed_markdown(pages, "html")) == 0
    assert shuffles(queries.detect_format(spark, sf)) == 0 and shuffles(queries.truncate_preview(spark, sf)) == 0


def test_structure_counts_shuffle_once(spark, sf):
    assert shuffles(queries.md_stats(spark, sf)) == 1


def test_layout_shuffles_spans_once_and_lines_once(spark, sf):
    spans = queries._spans(spark, sf)
    stats = spark.createDataFrame([(0, 12.0)], "doc_id long, body_font_size double")
    lines = layout.group_lines(spans)
    assert shuffles(lines) == 1
    marked = layout.paragraph_numbers(lines.withColumn("is_heading", F.col("font_size") > 14))
    assert shuffles(layout.classify(marked)) == 2
    assert plan(layout.classify(layout.paragraph_numbers(layout.mark_headings(lines, stats)))).count("MapInArrow") == plan(lines).count("MapInArrow")


def test_histogram_is_partly_counted_before_its_shuffle(spark, sf):
    assert "partial_count" in plan(layout.font_histogram(queries._pages(spark, sf)))


def test_scans_read_the_columns_they_need(spark, sf):
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in plan(queries.p95_nearest_rank(spark, sf))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(queries.output_names(spark, sf))
