"""From positioned text spans to lines, paragraphs and blocks, page by page.

spans: doc_id, page, seq, text, x_left, x_right, y_bottom, y_top, font_size; y grows upwards. Everything but the body
font size is local to a page: spans are shuffled by (doc_id, page) once, and what comes of them, far fewer lines, once
more for all windows and groupings over these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions.text import trim

_BULLETS = ["•", "-", "*", "o", "▪", "·", "◦"]
PAGE = ["doc_id", "page"]
#: Spans are folded in batches of about so many; Arrow batches may be far smaller where files come in them too.
GATHERED = 8_192


def font_histogram(pages: DataFrame) -> DataFrame:
    """Of ``light_pages(doc_id, page, char_count, line_heights)``: doc_id, bucket (half points), n."""
    heights = pages.where("char_count > 0").select("doc_id", F.explode("line_heights").alias("h")).where("h > 0")
    return heights.groupBy("doc_id", (F.round(F.col("h") / 0.5) * 0.5).alias("bucket")).agg(F.count("*").alias("n"))


def body_font(histogram: DataFrame) -> DataFrame:
    """doc_id, body_font_size: the bucket with most lines in it and its two neighbours; the larger of equals."""
    near = Window.partitionBy("doc_id").orderBy((F.col("bucket") * 2).cast("long")).rangeBetween(-1, 1)
    scored = histogram.withColumn("score", F.sum("n").over(near))
    return scored.groupBy("doc_id").agg(F.max_by("bucket", F.struct("score", "bucket")).alias("body_font_size"))


def doc_stats(pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """doc_id, body_font_size (0 without lines), total_pages, empty_pages, likely_scanned. Null counts of characters are 0."""
    pages = pages.withColumn("char_count", F.coalesce("char_count", F.lit(0)))
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if(F.col("char_count") <= 0).alias("empty_pages"))
    out = totals.join(body_font(font_histogram(pages)), "doc_id", "left")
    scanned = (F.col("total_pages") > 0) & (F.col("empty_pages") / F.col("total_pages") >= config.scanned_share)
    return out.select("doc_id", F.coalesce("body_font_size", F.lit(0.0)).alias("body_font_size"), "total_pages", "empty_pages", scanned.alias("likely_scanned"))


def group_lines(spans: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """lines: doc_id, page, line_no, text, first_x, y_top, y_bottom, font_size.

    Spans go from the top down; one joins the line before it if its centre is near enough to that line's. Equal centres
    and equal left edges go by seq. Each span depends on the line that is open before it: the spans, sorted by page,
    go through a kernel on Arrow batches that folds over them and holds one page at most besides a batch.
    """
    centre = (F.col("y_top") + F.col("y_bottom")) / 2
    doubles = [F.col(c).cast("double").alias(c) for c in ("x_left", "y_bottom", "y_top", "font_size")]
    rows = spans.select(*PAGE, F.col("seq").cast("long").alias("seq"), "text", *doubles, (-centre).alias("k"))
    ordered = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "k", "seq", "text", "x_left").drop("k")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return ordered.mapInArrow(_folder(config.line_tolerance_factor), f"{kinds}, line_no int, text string, first_x double, y_top double, y_bottom double, font_size double")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least GATHERED of them, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if any(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _folder(tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of sorted spans, batches of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the page that may go on
        for batch in _gathered(batches):
            cut = int(_page_starts(batch)[-1])
            if held and not cut and _page(held[-1], held[-1].num_rows - 1) == _page(batch, 0):
                held.append(batch)
                continue
            if held or cut:
                yield _lines([*held, batch.slice(0, cut)], tolerance)
            held = [batch.slice(cut)]
        if held:
            yield _lines(held, tolerance)

    return run


def _page(batch: pa.RecordBatch, row: int) -> tuple:
    return batch.column(0)[row].as_py(), batch.column(1)[row].as_py()


def _page_starts(batch: pa.RecordBatch) -> np.ndarray:
    ends = [pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in (0, 1)]
    return np.concatenate([[0], np.union1d(*ends)[:-1]])


def _lines(batches: list[pa.RecordBatch], tolerance: float) -> pa.RecordBatch:
    """The lines of whole pages."""
    spans = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    seq, x, bottoms, tops, sizes = (np.asarray(spans.column(k).to_numpy(zero_copy_only=False), float) for k in (2, 4, 5, 6, 7))  # null is NaN
    pages = _page_starts(spans)
    begins = np.zeros(len(seq), bool)
    begins[pages] = True
    fresh = begins.tolist()
    top = bottom = tall = 0.0
    for i, (t, b) in enumerate(zip(tops.tolist(), bottoms.tolist(), strict=True)):
        h = t - b
        taller = h if h > tall else tall
        if not fresh[i] and abs((t + b) / 2 - (top + bottom) / 2) <= taller * tolerance:
            top, bottom, tall = max(top, t), min(bottom, b), taller
        else:
            fresh[i] = True
            top, bottom, tall = t, b, h
    begins = np.array(fresh)
    line = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    first = lambda v: np.where(np.isnan(v), -np.inf, v)
    order = np.lexsort((first(seq), first(x), line))
    text = pc.fill_null(spans.column(3).take(pa.array(order)), "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(seq)], pa.int32()), text), "")
    at = pa.array(starts)
    no = np.arange(len(starts)) - np.repeat(line[pages], np.diff([*line[pages], len(starts)]))
    measures = (x[order][starts], np.fmax.reduceat(tops, starts), np.fmin.reduceat(bottoms, starts), np.fmax.reduceat(sizes, starts))
    columns = [spans.column(0).take(at), spans.column(1).take(at), pa.array(no, pa.int32()), joined, *(pa.array(m, from_pandas=True) for m in measures)]
    return pa.RecordBatch.from_arrays(columns, [*PAGE, "line_no", "text", "first_x", "y_top", "y_bottom", "font_size"])


def mark_headings(lines: DataFrame, stats: DataFrame, config: LayoutConfig = LayoutConfig(), how: str = "left") -> DataFrame:
    """lines with is_heading, by their document's body_font_size; without one, or with 0, there are no headings.

    With how="inner" only lines of documents in stats stay.
    """
    body = F.coalesce("body_font_size", F.lit(0.0))
    heading = (body > 0) & (F.col("font_size") >= body * config.heading_font_factor)
    return lines.join(stats.select("doc_id", "body_font_size"), "doc_id", how).withColumn("is_heading", heading).drop("body_font_size")


def paragraph_numbers(lines: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """lines (with is_heading) with gap and para_no, from 0 on each page.

    A paragraph ends before a gap above one and a half times the usual one, an indent, a heading and after a heading.
    The usual gap is the median of those below the page's median gap, or that median if there are none.
    """
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    whole = Window.partitionBy(*PAGE)
    out = lines.withColumn("gap", F.lag("y_bottom").over(order) - F.col("y_top"))
    out = out.withColumn("m1", F.percentile("gap", 0.5).over(whole))
    out = out.withColumn("m2", F.percentile(F.when(F.col("gap") < F.col("m1"), F.col("gap")), 0.5).over(whole))
    wide = F.col("gap") > F.coalesce("m2", "m1") * config.paragraph_gap_factor
    indent = F.col("first_x") > F.lag("first_x").over(order) + F.lag("font_size").over(order) * 0.5
    breaks = (F.col("line_no") > 0) & (F.coalesce(wide, F.lit(False)) | F.coalesce(indent, F.lit(False)) | F.col("is_heading") | F.coalesce(F.lag("is_heading").over(order), F.lit(False)))
    return out.withColumn("para_no", F.sum(breaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("m1", "m2")


def classify(paragraphs: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """blocks of numbered lines: headings (level 1), list items (an item for each bullet line) and paragraphs."""
    bullets = [b for b in _BULLETS if not (config.strict_bullets and b == "o")]
    order = Window.partitionBy(*PAGE, "para_no").orderBy("line_no")
    out = paragraphs.withColumn("t", trim(F.col("text")))
    out = out.withColumn("bullet", F.substring("t", 1, 1).isin(bullets))
    kind = F.when(F.first("is_heading").over(order), "heading").when(F.first("bullet").over(order), "listItem").otherwise("paragraph")
    out = out.withColumn("type", kind)
    item = F.when(F.col("type") == "listItem", F.sum(F.col("bullet").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    t = F.when((F.col("type") == "listItem") & F.col("bullet"), trim(F.expr("substring(t, 2)"))).otherwise(F.col("t"))
    out = out.withColumn("item_no", item).withColumn("t", t)
    blocks = out.groupBy(*PAGE, "para_no", "item_no").agg(F.min("type").alias("type"), F.sort_array(F.collect_list(F.struct("line_no", "t")))["t"].alias("ts"))
    numbered = Window.partitionBy(*PAGE).orderBy("para_no", "item_no")
    return blocks.select(
        *PAGE, (F.row_number().over(numbered) - 1).alias("block_no"), "type", F.when(F.col("type") == "heading", 1).otherwise(0).alias("level"),
        F.when(F.col("type") == "listItem", F.col("ts")).otherwise(F.array(trim(F.array_join("ts", " ")))).alias("lines"), F.lit(None).cast("string").alias("raw"),
    )


def layout_blocks(spans: DataFrame, stats: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """spans and doc_stats to blocks; documents that look scanned, and those without stats, have none.

    Documents are told apart by their lines, of which there are far fewer than spans: spans are shuffled once, by page.
    """
    kept = stats.where(~F.col("likely_scanned")) if "likely_scanned" in stats.columns else stats
    return classify(paragraph_numbers(mark_headings(group_lines(spans, config), kept, config, "inner"), config), config)
