"""Scores of converted Markdown against golden texts, by set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, trim


def eval_blocks(texts: DataFrame, column: str = "markdown") -> DataFrame:
    """Each non-blank line of ``texts(name, <column>)``, without backslashes: name, no, type, text."""
    line = trim(F.col("line"))
    lines = texts.select("name", F.posexplode(F.split(trim(F.replace(F.col(column), F.lit("\\"), F.lit(""))), "\n")).alias("no", "line")).withColumn("line", line).where("line <> ''")
    heading, item = F.col("line").startswith("#"), F.col("line").startswith("- ")
    kind = F.when(heading, "heading").when(item, "list").otherwise("paragraph")
    text = F.when(heading, F.regexp_replace("line", rf"\A#+{SPACE_CLASS}*", "")).when(item, F.expr("substring(line, 3)")).otherwise(F.col("line"))
    return lines.select("name", "no", kind.alias("type"), text.alias("text"))


def _share(hit: Column, all_: Column) -> Column:
    return F.when(all_ > 0, hit / all_).otherwise(1.0)


def threshold(name: Column) -> Column:
    return F.when(name.startswith("with_tables"), 0.60).otherwise(0.90)


def evaluate(output: DataFrame, golden: DataFrame) -> DataFrame:
    """For each name of both ``(name, markdown)`` tables: paragraph_f1, heading_accuracy, list_recall, noise_blocks, passed.

    Paragraphs count once each; golden headings and list items as often as they stand, 1.0 if there are none. Noise:
    output lines whose text is not in the golden text. A name without a golden text is left out.
    """
    names = golden.select("name").distinct().join(output.select("name").distinct(), "name")
    out, gold = eval_blocks(output), eval_blocks(golden)
    # a row for each name and text: how often it stands in either as what
    n = lambda kind: F.count_if(F.col("type") == kind)
    kinds = ("paragraph", "heading", "list")
    o = out.groupBy("name", "text").agg(*[n(k).alias(f"o_{k}") for k in kinds], F.count("*").alias("o_all"))
    g = gold.groupBy("name", "text").agg(*[n(k).alias(f"g_{k}") for k in kinds], F.count("*").alias("g_all"))
    both = o.join(g, ["name", "text"], "full").fillna(0)
    c = F.col
    sums = both.groupBy("name").agg(
        F.count_if((c("o_paragraph") > 0) & (c("g_paragraph") > 0)).alias("tp"), F.count_if(c("o_paragraph") > 0).alias("np"), F.count_if(c("g_paragraph") > 0).alias("ng"),
        *[F.sum(F.when(c(f"o_{k}") > 0, c(f"g_{k}")).otherwise(0)).alias(f"hit_{k}") for k in ("heading", "list")], *[F.sum(f"g_{k}").alias(f"all_{k}") for k in ("heading", "list")],
        F.sum(F.when(c("g_all") == 0, c("o_all")).otherwise(0)).alias("noise"),
    )
    rows = names.join(sums, "name", "left").fillna(0)
    p, r = c("tp") / c("np"), c("tp") / c("ng")
    f1 = F.when(c("tp") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return rows.select(
        "name", f1.alias("paragraph_f1"), _share(c("hit_heading"), c("all_heading")).alias("heading_accuracy"), _share(c("hit_list"), c("all_list")).alias("list_recall"),
        c("noise").cast("long").alias("noise_blocks"), (f1 >= threshold(c("name"))).alias("passed"),
    )


def noise_blocks(output: DataFrame, golden: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` output lines of each name that are not in its golden text: name, no, text."""
    from pyspark.sql import Window

    rest = eval_blocks(output).join(eval_blocks(golden).select("name", "text").distinct(), ["name", "text"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("no"))
    return rest.withColumn("k", rank).where(F.col("k") <= most).select("name", "no", "text")


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Of each group by the columns ``by``: these, and ``value`` at floor(n * share) of its sorted values.

    By counts of equal values, so that a large group is not gathered in one place. Nulls do not count; a group without
    values has no row.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    at = F.least(F.floor(F.col("__all") * share), F.col("__all") - 1)
    return ranked.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at)).select(*by, value)
