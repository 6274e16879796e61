"""Generated documents: a book and its golden text, by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The texts of the generated book, with the page's number for %s, and of the report, as published.
_CHAPTER = "Chapter %s"
_FIRST = "Page %s paragraph one with some body text that fills a line."
_FIRST_GOES_ON = "It continues onto a second line of the paragraph."
_SECOND = "A second paragraph follows after a small gap."
_ITEMS = ["Bullet number one on page %s", "Bullet number two on page %s"]
_TITLE = "Inventory Report"
_REPORT = [("Name", "Qty", "Price"), ("Apples", "10", "2.50"), ("Bananas", "20", "1.75"), ("Cherries", "5", "8.00")]
_CLOSING = "End of table with plain text after."


def book_items(spark: SparkSession, pages: int, chapter_every: int = 20) -> DataFrame:
    """page, seq, text, font_size, x, y of a book: two body lines, a second paragraph and two list items a page, and a heading every so many pages."""
    item = lambda text, size, y: F.struct(text.alias("text"), F.lit(float(size)).alias("font_size"), F.lit(72.0).alias("x"), F.lit(float(y)).alias("y"))
    of_page = lambda text: F.format_string(text, F.col("page").cast("string"))
    chapter = F.format_string(_CHAPTER, (F.floor(F.col("page") / chapter_every) + 1).cast("string"))
    items = F.array(
        F.when(F.col("page") % chapter_every == 0, item(chapter, 22, 700)), item(of_page(_FIRST), 12, 660), item(F.lit(_FIRST_GOES_ON), 12, 640), item(F.lit(_SECOND), 12, 600),
        *[item(of_page(f"- {text}"), 12, 560 - 20 * k) for k, text in enumerate(_ITEMS)],
    )
    rows = spark.range(pages).select(F.col("id").cast("int").alias("page")).select("page", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("seq", "e"))
    return rows.select("page", "seq", "e.*")


def item_spans(items: DataFrame, doc_id: int = 0, height: float = 0.945, width: float = 0.5) -> DataFrame:
    """The spans that drawing the items gives."""
    size = F.col("font_size")
    return items.select(
        F.lit(doc_id).cast("long").alias("doc_id"), "page", "seq", "text", F.col("x").alias("x_left"), (F.col("x") + F.length("text") * size * width).alias("x_right"),
        F.col("y").alias("y_bottom"), (F.col("y") + size * height).alias("y_top"), (size * height).alias("font_size"),
    )


def book_golden(spark: SparkSession, pages: int, chapter_every: int = 20) -> DataFrame:
    """name, markdown: what the book should become, by the rule it is made by."""
    chapter = F.format_string(f"# {_CHAPTER}\n\n", (F.floor(F.col("id") / chapter_every) + 1).cast("string"))
    page = "\n\n".join([f"{_FIRST} {_FIRST_GOES_ON}", _SECOND, *[f"- {text}" for text in _ITEMS], ""])
    parts = F.concat(F.when(F.col("id") % chapter_every == 0, chapter).otherwise(""), F.replace(F.lit(page), F.lit("%s"), F.col("id").cast("string")))
    return spark.range(pages).agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", parts.alias("p"))))["p"], "").alias("markdown")).select(F.lit("book_single.md").alias("name"), "markdown")


def report_items(spark: SparkSession) -> DataFrame:
    """The items of a page with a title, rows that look like a table, and a closing line."""
    rows = [(_TITLE, 20.0, 740.0)] + [(f"{a:<12}  {b:<6}  {c}", 12.0, 700.0 - 22 * k) for k, (a, b, c) in enumerate(_REPORT)]
    rows.append((_CLOSING, 12.0, 700.0 - 22 * len(_REPORT) - 10))
    return spark.createDataFrame([(0, k, t, size, 72.0, y) for k, (t, size, y) in enumerate(rows)], "page int, seq int, text string, font_size double, x double, y double")


def report_golden(spark: SparkSession) -> DataFrame:
    """name, markdown: the report with a paragraph for each row."""
    rows = "\n".join(f"{a:<13}{b:<7}{c}" for a, b, c in _REPORT)
    return spark.createDataFrame([("with_tables.md", f"# {_TITLE}\n\n{rows}\n\n{_CLOSING}\n")], "name string, markdown string")


def light_pages(spans: DataFrame) -> DataFrame:
    """doc_id, page, char_count, line_heights of spans that are a line each."""
    return spans.groupBy("doc_id", "page").agg(F.sum(F.length("text")).cast("int").alias("char_count"), F.collect_list("font_size").alias("line_heights"))


def pdf_of_items(items: DataFrame) -> bytes:
    """The items (of one small document) as a PDF file."""
    from .pdf import write_pdf

    pages: dict[int, list] = {}
    for r in items.orderBy("page", "seq").collect():
        pages.setdefault(r["page"], []).append((r["text"], r["font_size"], r["x"], r["y"]))
    return write_pdf([pages.get(k, []) for k in range(max(pages, default=-1) + 1)])
