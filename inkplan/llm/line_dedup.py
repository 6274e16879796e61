"""Line dedup by site-relative frequency: lines on too large a share of their host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: A line on more than this share of its host's pages is boilerplate, if it stands on more than one page at all.
MAX_RATIO = 0.05
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Boilerplate lines: host, line (hash of the line without spaces around it), n_pages, host_pages.

    A line counts once for a page; one on a single page is none, however few pages the host has. Blank lines do not count. Rows with a null host are one host. A host has fewer of
    these than its mean number of different lines on a page divided by max_ratio, however many pages it has.
    """
    keyed = pages.select(host.alias("host"), text.alias("text"))
    totals = keyed.groupBy("host").agg(F.count("*").alias("host_pages"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(F.trim(x))))
    each = keyed.select("host", F.explode(own).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = totals.select(F.col("host").alias("of"), "host_pages")
    both = counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
    return both.where(F.col("n_pages") > max_ratio * F.col("host_pages")).select("host", "line", "n_pages", "host_pages")


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """pages with the boilerplate lines taken out of ``text``; all rows and columns stay.

    With counts, also n_lines and n_dropped (0 for a null text, which stays null; a text of boilerplate only becomes
    empty); they take the place of columns of pages with these names. Repeated rows are pages of their own, each counted. An empty table stays empty.
    """
    bad = boilerplate(pages, F.col(host), F.col(text), max_ratio, min_pages)
    per_host = written(bad.groupBy("host").agg(F.collect_set("line").alias("__line_dedup_bad")).withColumnRenamed("host", "__line_dedup_host"), "boilerplate")
    size = per_host.agg(F.sum(F.size("__line_dedup_bad"))).first()[0] or 0
    per_host = small(per_host) if size <= 1_000_000 else per_host  # broadcast only if its hosts and lines are few
    joined = pages.join(per_host, pages[host].eqNullSafe(per_host["__line_dedup_host"]), "left")
    lines = _lines(pages[text])
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__line_dedup_bad"), F.xxhash64(F.trim(x))))
    changed = F.when(F.col("__line_dedup_bad").isNull(), pages[text]).otherwise(F.array_join(kept, "\n"))
    out = [changed.alias(text) if c == text else pages[f"`{c}`"] for c in pages.columns if not (counts and c.lower() in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0))
        n = F.when(pages[text].isNull(), 0).otherwise(n)
        dropped = F.when(F.col("__line_dedup_bad").isNull() | pages[text].isNull(), 0).otherwise(n - F.size(kept))
        out += [n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")]
    return joined.select(*out)
