"""Counts of Markdown structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines, trim


def md_stats(docs: DataFrame) -> DataFrame:
    """headings, paragraphs, list_items and table_rows of ``docs(doc_id, markdown)``, outside fenced code.

    Lines that follow each other without a mark are one paragraph. A null or empty text has none.
    """
    lines = docs.select("doc_id", F.posexplode_outer(split_lines(F.col("markdown"))).alias("no", "line")).withColumn("t", trim(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("no")
    fence = F.coalesce(F.col("t").startswith("```"), F.lit(False))
    lines = lines.withColumn("fence", fence).withColumn("inside", F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    t = F.col("t")
    kind = (
        F.when(t.isNull() | (t == ""), "blank").when(F.col("fence"), "fence").when(F.coalesce("inside", F.lit(0)) % 2 == 1, "code")
        .when(t.startswith("#"), "heading").when(t.startswith("- ") | t.startswith("* "), "list")
        .when(t.startswith("|") & t.endswith("|"), "row").otherwise("plain")
    )
    # blank lines in code do not end a paragraph: the fence before them has
    lines = lines.withColumn("kind", kind)
    first = F.coalesce(F.lag("kind").over(order), F.lit("blank")) != "plain"
    lines = lines.withColumn("starts", (F.col("kind") == "plain") & first)
    count = lambda k: F.count_if(F.col("kind") == k)
    return lines.groupBy("doc_id").agg(count("heading").alias("headings"), F.count_if("starts").alias("paragraphs"), count("list").alias("list_items"), count("row").alias("table_rows"))
