"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index has a list of positions for each term and document. Of each benchmark window (eight consecutive words) the two
rarest terms over all documents are looked up first: their lists, each less the term's offset in the window, are
intersected to the places where the window may start. Only for documents where that leaves any, the lists of the
window's other terms are made and intersected too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_count, remove, small, words, written

WINDOW = 8
#: A document: rows equal in both have equal results.
DOC = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items(item_id, text)``: win array<string>, ids array<item_id> (of the items that have it)."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = own.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item_id").alias("ids"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms(term)`` stands in the documents: term, n. Terms are counted where they are read, then met."""
    tokens = _keyed(docs).select(F.explode("words").alias("term"))
    few = small(terms)
    if few is not terms:
        return tokens.join(few, "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def posting_lists(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The index of ``counts(term, n)``: doc_id, text_hash, term, at (the positions, from 0, in no order)."""
    tokens = _keyed(docs).select(*DOC, F.posexplode("words").alias("pos", "term"))
    terms = counts.select("term")
    few = small(terms)
    lists = (tokens.join(few, "term") if few is not terms else tokens).groupBy(*DOC, "term").agg(F.collect_set("pos").alias("at"))
    if few is not terms:
        return lists
    whole = written(lists, "all-postings")  # a term's documents are as many as its places at most
    return join_by_count(whole, counts, "term", "n", whole.count()).drop("n")


def search_plan(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``windows(wid, win, ids)``: wid, n (words), first and second (n, off, term: the rarest ones, the second null for
    one word), rest (the others); and the counts of the terms looked up first.

    Windows with a word that no document has are left out. Equally rare ones go by their place in the window.
    """
    each = windows.select("wid", F.posexplode("win").alias("off", "term"))
    counts = written(term_counts(docs, each.select("term").distinct()), "term-counts")
    ranked = each.join(counts, "term").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("r"))
    ranked = ranked.join(windows, "wid").where(F.size("r") == F.size("win"))
    plan = ranked.select("wid", F.size("r").alias("n"), F.col("r")[0].alias("first"), F.try_element_at("r", F.lit(2)).alias("second"), F.slice("r", 3, WINDOW + 1_000_000).alias("rest"))
    plan = written(plan, "search-plan")
    used = plan.select(F.explode(F.array("first", "second")).alias("t")).where("t is not null")
    return plan, used.select("t.term", "t.n").distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Places where windows occur: doc_id, text_hash, at (the word where it starts, from 0), n (its words), ids, kind.

    kind is ``exact`` for the phrase itself. With ``slop`` there are also ``proximity`` matches: all of a window's
    distinct words within the window's own words and slop more on either side of where the rarest word puts it.
    """
    windows = written(item_windows(items, window).withColumn("wid", F.monotonically_increasing_id()), "windows")
    plan, rare = search_plan(docs, windows)
    lists = written(posting_lists(docs, written(rare, "rare-terms")), "postings")

    def fits(start: Column, at: Column, off: Column, n: Column) -> Column:
        """Whether a term's positions hold its place in the window, or with slop one near it."""
        exact = F.array_contains(at, start + off)
        return exact if slop is None else exact | F.exists(at, lambda p: (p >= start - slop) & (p < start + n + slop))

    by_term = plan.select("wid", "n", "second", "rest", F.col("first.term").alias("term"), F.col("first.off").alias("off"))
    starts = F.filter(F.transform("at", lambda p: p - F.col("off")), lambda s: s >= (0 if slop is None else -(window + slop)))
    found = lists.join(small(by_term), "term").select(*DOC, "wid", "n", "second", "rest", starts.alias("starts"))
    one = found.where("second is null")
    two = found.where("second is not null")
    other = lists.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("term").alias("o_term"), F.col("at").alias("o_at"))
    two = two.join(other, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("second.term") == F.col("o_term")))
    if slop is None:
        met = F.array_intersect("starts", F.transform("o_at", lambda p: p - F.col("second.off")))
    else:
        met = F.filter("starts", lambda s: fits(s, F.col("o_at"), F.col("second.off"), F.col("n")))
    two = two.select(*DOC, "wid", "n", "second", "rest", met.alias("starts"))
    left = written(one.unionByName(two).where(F.size("starts") > 0).select(*DOC, "wid", "n", "second", "rest", F.explode("starts").alias("start")), "candidates")
    remove(lists)
    # the other terms, where there are some, and with slop all of them once more to tell exact ones
    again = F.col("rest") if slop is None else F.concat("rest", F.when(F.col("second").isNotNull(), F.array("second")).otherwise(F.array().cast("array<struct<n:bigint,off:int,term:string>>")))
    asked = left.select(*DOC, "wid", "n", "start", F.explode(again).alias("t")).select(*DOC, "wid", "n", "start", "t.term", "t.off")
    there = left.select(*DOC).distinct()
    some = docs.withColumn("text_hash", F.xxhash64("text"))
    some = some.join(small(there), some["doc_id"].eqNullSafe(there["doc_id"]) & (some["text_hash"] == there["text_hash"]), "left_semi").drop("text_hash")
    terms = plan.select(F.explode(again).alias("t")).select("t.term", "t.n").distinct()
    rest = posting_lists(some, written(terms, "other-terms")).select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("term").alias("o_term"), "at")
    both = asked.join(rest, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("term") == F.col("o_term")))
    both = both.where(fits(F.col("start"), F.col("at"), F.col("off"), F.col("n")))
    exact = F.array_contains("at", F.col("start") + F.col("off"))
    proven = both.groupBy(*DOC, "wid", "start").agg(F.count_distinct("off").alias("fit"), F.count_distinct(F.when(exact, F.col("off"))).alias("exact"))
    proven = proven.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), F.col("wid").alias("p_wid"), F.col("start").alias("p_start"), "fit", "exact")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")) & (F.col("wid") == F.col("p_wid")) & (F.col("start") == F.col("p_start"))
    done = left.withColumn("wanted", F.size(again)).join(proven, same, "left").where(F.coalesce("fit", F.lit(0)) == F.col("wanted"))
    kind = F.when((F.coalesce("exact", F.lit(0)) == F.col("wanted")) & (F.col("start") >= 0), "exact").otherwise("proximity")
    ids = windows.select(F.col("wid").alias("w_id"), "ids")
    out = done.select(*DOC, "wid", F.col("start").alias("at"), "n", kind.alias("kind")).distinct()
    return out.join(small(ids), F.col("wid") == F.col("w_id")).select(*DOC, "at", "n", "ids", "kind")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any exact occurrence of a window is hit; an item of fewer words, but not none, is one window. A null
    or empty text has no words; items without words, and null item_ids in the list that is hashed, do not count.
    Rows with equal doc_id and text all get their result. Texts are searched whole. Further columns are ignored; an
    empty table gives no rows, and without items nothing is hit.
    """
    hits = matches(docs, items, window).groupBy(*DOC).agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))  # a document's own
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.size(covered).cast("long").alias("hit"), "ids")
    rows = _keyed(docs).select(*DOC, F.size("words").cast("long").alias("n_words"))
    both = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    ids = F.sort_array(F.transform(F.coalesce("ids", F.array()), lambda i: i.cast("string")))
    n_items = F.size(F.coalesce("ids", F.array())).cast("long")
    return both.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """The rows of docs, with their columns, that hold windows of fewer than ``min_items`` items."""
    hits = matches(docs, items, window).groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    bad = small(written(hits.where(F.size("ids") >= min_items).select(F.col("doc_id").alias("__contaminated_id"), F.col("text_hash").alias("__contaminated_hash")), "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__contaminated_id"]) & (F.xxhash64(docs["text"]) == bad["__contaminated_hash"]), "left_anti")
