"""Near-duplicates by Order MinHash over five-word shingles, candidates verified by banded alignment.

A sketch is the ``PICKED`` smallest hashes of a text's shingles, each labelled by its occurrence, kept in text order:
two texts share one if they have the same shingles in the same order often enough. Texts that share a sketch are
candidates. Short texts, where few sketches can be shared, are candidates too if they share one of their rarest
shingles, so many of these that none of their pairs is missed. A bucket's texts are not paired with each other but with
a few leaders, those with most company over all sketches. Where a bucket's texts are still in several components, an index of their shingles finds those pairs between
components that may be linked, and these are aligned too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_by_count, py_words, release_memory, remove, small, words, written

SHINGLE = 5
#: Sketches of a text, and shingles in one: of pairs with similarity 0.8 and many shingles, 1 - (1 - 0.8**5)**20 = 99.96 %
#: share one. With c of u shingles common it is C(c, 5) / C(u, 5) instead of 0.8**5: 99.94 % at least beyond SHORT.
SKETCHES = 20
PICKED = 5
#: Pairs of which a text has at most so many shingles are found by their rarest shingles, all of them.
SHORT = 40
#: Texts of a bucket that all others of it are aligned with.
LEADERS = 3
#: Texts, and shingles of texts, that are indexed together where a bucket's texts are still in several components, about.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sketcher:
    """Sketches of texts, given as the hashes (uint64) of their words."""

    def __init__(self, sketches: int = SKETCHES, picked: int = PICKED):
        self.picked = picked
        self._seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
        self._powers = _mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | _U(1)

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the shingles of a text with these hashes of words; the whole text is one if it is shorter."""
        k = min(SHINGLE, len(h))
        n = len(h) - k + 1
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += h[j : j + n] * self._powers[j]
        out = _mix(out + _U(k))
        ordered = np.sort(out)
        if (ordered[1:] == ordered[:-1]).any():  # label by occurrence
            at = np.argsort(out, kind="stable")
            s = out[at]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            occurrence = np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))
            again = occurrence > 0  # the first is as in a text that has it once
            out[at[again]] = _mix(s[again] + occurrence[again].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        return out

    def sketch(self, h: np.ndarray) -> np.ndarray:
        x = self.shingles(h)
        k = min(self.picked, len(x))
        out = np.empty(len(self._seeds), np.uint64)
        step = max(1, (1 << 20) // len(x))
        for at in range(0, len(self._seeds), step):
            y = np.multiply.outer(self._seeds[at : at + step], x)
            y ^= y >> _U(29)
            y *= _U(0xBF58476D1CE4E5B9)
            y ^= y >> _U(32)
            pick = np.argpartition(y, k - 1, axis=1)[:, :k]
            pick.sort(axis=1)  # the order in the text
            v = np.full(len(pick), k, np.uint64)
            for j in range(k):
                v = _mix(v * _U(31) + x[pick[:, j]])
            out[at : at + step] = _mix(v ^ self._seeds[at : at + step])
        return out.view(np.int64)


def shingle_list(tokens: list[str]) -> list[tuple[str, ...]]:
    return list(zip(*(tokens[j:] for j in range(SHINGLE)), strict=False)) if len(tokens) >= SHINGLE else [tuple(tokens)]


def aligned(a: list, b: list, similarity: float) -> float:
    """The similarity of the best alignment of two sequences, common / (all - common), or 0 if below ``similarity``.

    Alignments of similar sequences stay within a band around the diagonal: each step off it costs an item. The rows of
    the band are computed bit-parallel, one integer for a row.
    """
    total = len(a) + len(b)
    need = similarity * total / (1 + similarity) - 1e-9  # common items
    if min(len(a), len(b)) < need:
        return 0.0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    common = lo + hi
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if a and b:
        band = int(total - 2 * need) + 1
        at: dict = {}
        for j, x in enumerate(b):
            at[x] = at.get(x, 0) | 1 << j
        if common + sum(1 for x in a if x in at) < need:
            return 0.0
        width, full = (1 << 2 * band + 1) - 1, (1 << len(b)) - 1
        v = full
        for i, x in enumerate(a):
            m = at.get(x)
            if m:
                m &= width << i - band if i > band else width >> band - i
                u = v & m
                v = (v + u | v - u) & full
        common += len(b) - v.bit_count()
    return common / (total - common) if common >= need else 0.0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs: node, comp (a node of the same component, the same for all of it).

    Each round maps every node to that of its neighbours and itself with the least hash, and keeps the edges between
    nodes that still differ; a round takes away a fixed share of the nodes, so rounds grow with their logarithm.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    result = None
    turn = 0
    while turn == 0 or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("x"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("x"))
        least = both.groupBy("a").agg(F.min(key).alias("k")).select(F.col("a").alias("node"), F.least("k", own)["x"].alias("comp"))
        step = written(least, f"{name}-map")
        before = result
        if before is None:
            result = step
        else:
            nxt = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            result = written(before.join(nxt, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), name)
        m = step.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        n = step.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        pairs = left.join(m, "a").join(n, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        pairs = written(pairs, f"{name}-edges")
        remove(left, before, step if before is not None else None)
        left = pairs
        turn += 1
    remove(left)
    return result


def _content(text: Column) -> Column:
    """A hash of a text's words; null if it has none."""
    tokens = words(text)
    return F.when(F.size(tokens) > 0, F.xxhash64(tokens))


def _sketches(docs: DataFrame, short: int) -> DataFrame:
    """Of ``docs(doc_id, text)``: doc_id, content, n (shingles), sketches, short (the shingles, if at most so many); the last three only where a task meets a content first."""
    schema = "doc_id long, content long, n long, sketches array<long>, short array<long>"
    tokens = docs.select("doc_id", words(F.col("text")).alias("w"))
    keyed = tokens.select("doc_id", F.when(F.size("w") > 0, F.xxhash64("w")).alias("content"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Sketcher(), set()
        for batch in batches:
            ends, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64)
            n: list[int | None] = []
            made: list[np.ndarray | None] = []
            few: list[np.ndarray | None] = []
            for k, content in enumerate(batch.column(1).to_pylist()):
                if content is None or content in seen:
                    n.append(None)
                    made.append(None)
                    few.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(content)
                h = flat[ends[k] : ends[k + 1]]
                n.append(max(1, len(h) - SHINGLE + 1))
                made.append(maker.sketch(h))
                few.append(maker.shingles(h).view(np.int64) if n[-1] <= short else None)
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (made, few))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), *lists], ["doc_id", "content", "n", "sketches", "short"])
        release_memory()

    return keyed.mapInArrow(run, schema)


def _short_buckets(contents: DataFrame, similarity: float) -> DataFrame:
    """Of ``contents(content, n, short)``: content, n, bucket, a row for each of a text's rarest shingles that others have too.

    Of two texts with that similarity, each has at least similarity * n of its n shingles in common with the other. So one
    of its n - similarity * n + 1 rarest is common, and for one order of all shingles they share such a one.
    """
    items = written(contents.select("content", "n", F.explode("short").alias("shingle")), "short-shingles")
    common = small(written(items.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1"), "common-shingles"))
    each = items.join(common, "shingle", "left").select("content", "n", F.struct(F.coalesce("many", F.lit(1)).alias("many"), "shingle").alias("s"))
    first = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    rarest = each.groupBy("content", "n").agg(F.sort_array(F.collect_list("s")).alias("s")).select("content", "n", F.explode(F.slice("s", F.lit(1), first)).alias("s"))
    return rarest.where("s.many > 1").select("content", "n", F.col("s.shingle").alias("bucket"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs(a, b)``, those with that similarity."""
    b = texts.select(F.col("content").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("content").alias("a"), F.col("text").alias("text_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, keep = whole.slice(at, 256), []
                for x, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if x != last:
                        last, first = x, shingle_list(py_words(text_a))
                    keep.append(aligned(first, shingle_list(py_words(text_b)), similarity) > 0)
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _likely_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of ``members(bucket, content, comp, blocks)``: pairs (a, b) of a bucket's texts in different components whose shingles
    have that similarity as multisets, which an alignment cannot exceed.

    A bucket's shingles are indexed in its blocks and pairs of blocks, each in a group of its own; only pairs that pass
    leave it. A text's shingles are all different, so that it meets each posting of its group once at most.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        maker = Sketcher()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hashes = (np.array([xxhash.xxh64_intdigest(w) for w in py_words(t)], np.uint64) for t in batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([maker.shingles(h).astype("<u4").tobytes() for h in hashes], pa.binary())], ["content", "shingles"])

    own = F.pmod(F.xxhash64("content"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = members.withColumn("own", own).withColumn("other", other).select("bucket", "content", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    wanted = small(members.select("content").distinct())
    made = written(texts.join(wanted, "content", "left_semi").mapInArrow(shingled, "content long, shingles binary"), "shingles")

    def compare(group: pa.Table) -> pa.Table:
        content, comp = group.column("content").to_numpy(), group.column("comp").to_numpy()
        each = [np.frombuffer(b, "<u4") for b in group.column("shingles").to_pylist()]
        n = np.array([len(x) for x in each])
        _, shingle = np.unique(np.concatenate(each), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(shingle, kind="stable")
        posted, ends = owner[order], np.cumsum(np.bincount(shingle))
        starts, text_ends = np.concatenate([[0], ends[:-1]]), np.cumsum(n)
        names, sizes = np.unique(comp, return_counts=True)
        left, right = [], []
        for k in np.flatnonzero(comp != names[sizes.argmax()]):  # pairs within the largest component need no look
            mine = shingle[text_ends[k] - n[k] : text_ends[k]]
            length = ends[mine] - starts[mine]
            first = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
            common = np.bincount(posted[first + np.arange(len(first))], minlength=len(n))
            good = (common * (1 + similarity) >= similarity * (n + n[k]) - 1e-6) & (comp != comp[k])
            right += np.flatnonzero(good).tolist()
            left += [k] * int(good.sum())
        a, b = content[left], content[right]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return spread.join(made, "content").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def content_classes(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs(doc_id, text)`` as a written table (doc_id, content: hash of the words, null if none), and for
    contents with links: node, comp."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_sketches(plain, int(SHORT / similarity + 1e-9)), "sketches")
    each = rows.where("sketches is not null").dropDuplicates(["content"]).select("content", "n", F.explode("sketches").alias("bucket"))
    short = rows.where("short is not null").select("content", "n", "short").dropDuplicates(["content"])
    each = each.unionByName(_short_buckets(short, similarity))
    full = each.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    shared = written(each.join(full, "bucket"), "members")
    company = shared.groupBy("content").agg(F.sum("many").alias("company"))
    members = written(shared.join(company, "content").select("bucket", "content", "n", "company"), "ranked")
    remove(shared)
    # the text of each content in a bucket: that of its least doc_id
    needed = members.select("content").distinct()
    first = rows.where(F.col("content").isNotNull()).groupBy("content").agg(F.min("doc_id").alias("doc_id"))  # copies meet after each task has only one
    rep_table = written(first.join(needed, "content", "left_semi"), "representatives")
    ids, rep = small(rep_table.select("doc_id"), 1_000_000), small(rep_table.select(F.col("content").alias("rep"), F.col("doc_id").alias("rep_id")), 1_000_000)
    chosen = plain.join(ids.withColumnRenamed("doc_id", "some_id"), F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi").withColumn("content", _content(F.col("text")))
    texts = chosen.join(rep, (F.col("content") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    texts = written(texts.select("content", "text").dropDuplicates(["content"]), "texts")

    w = Window.partitionBy("bucket").orderBy(F.col("company").desc(), "content")
    lead = members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= LEADERS).select("bucket", F.col("content").alias("lead"), F.col("n").alias("lead_n"))
    near = F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n") - 1e-9
    pairs = members.join(lead, "bucket").where((F.col("content") != F.col("lead")) & near)
    pairs = written(pairs.select(F.least("content", "lead").alias("a"), F.greatest("content", "lead").alias("b")).distinct(), "pairs")
    links = written(_verified(pairs, texts, similarity), "links")
    comps = connected_components(links)
    # where texts of a bucket are still in several components: all that may be linked between these, by common shingles
    of = comps.select(F.col("node").alias("content"), F.col("comp").alias("of"))
    placed = members.join(of, "content", "left").select("bucket", "content", "n", F.coalesce("of", "content").alias("comp"))
    several = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("many"), F.sum("n").alias("shingles")).where(f"x <> y and many > {LEADERS}")
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.least("many", F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    rest = placed.join(several.select("bucket", blocks.alias("blocks")), "bucket").select("bucket", "content", "comp", "blocks")
    further = written(_likely_links(rest, texts, similarity).join(pairs, ["a", "b"], "left_anti").distinct(), "further-pairs")
    if not further.isEmpty():
        comps = connected_components(links.unionByName(written(_verified(further, texts, similarity), "further-links")))
    remove(members, rep_table, texts, pairs, links, further)
    return rows.select("doc_id", "content"), comps


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, class_id (the least doc_id of its group), class_size (rows).

    Two texts are linked if the alignment of their five-word shingles has that similarity (common over all); texts
    with the same words are linked too, and groups are closed over links. A text of fewer than five words is one
    shingle. Null, empty and other texts without words have no links: each such row is a class of its own, under its own
    doc_id. Equal rows are kept. Rows with a null doc_id count, and a group of them only has a null class_id. Other
    columns are ignored; an empty table gives no rows.
    """
    rows, comps = content_classes(docs, similarity)
    worded = rows.where(F.col("content").isNotNull())
    per_content = worded.groupBy("content").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    labelled = written(per_content.join(comps.withColumnRenamed("node", "content"), "content", "left").withColumn("comp", F.coalesce("comp", "content")), "labelled")
    whole = written(labelled.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("many").alias("class_size"), F.count("*").alias("contents")), "whole-classes")
    classes = written(join_by_count(labelled, whole, "comp", "contents", labelled.count()).select("content", "many", "class_id", "class_size"), "classes")
    remove(labelled, whole)
    out = join_by_count(worded, classes, "content", "many", rows.count()).select("doc_id", "class_id", "class_size")
    alone = rows.where(F.col("content").isNull())
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def first_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with their columns, of which one of each group stays: that of its least doc_id (see near_duplicates).

    Of rows equal in doc_id and words any one; rows without words all stay.
    """
    rows, comps = content_classes(docs, similarity)
    worded = rows.where(F.col("content").isNotNull())
    least = worded.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("x"))).alias("first"))
    labelled = least.join(comps.withColumnRenamed("node", "content"), "content", "left").withColumn("comp", F.coalesce("comp", "content"))
    keep = labelled.groupBy("comp").agg(F.min(F.struct("first", "content")).alias("k")).select(F.col("k.first.x").alias("keep_id"), F.col("k.content").alias("keep_content"))
    # by what goes, which is less than what stays
    goes = worded.join(keep, (F.col("content") == F.col("keep_content")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_anti")
    goes = written(goes.select(F.col("doc_id").alias("__goes_id"), F.col("content").alias("__goes_content")).distinct(), "goes")
    goes = small(goes, 1_000_000)
    marked = docs.withColumn("__content", _content(docs["text"]))
    one = marked.join(goes, (F.col("__content") == F.col("__goes_content")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__goes_id")), "left_anti")
    if not worded.groupBy("doc_id", "content").count().where("count > 1").isEmpty():
        # equal rows: a shuffle of the texts, only where there are some; rows without words all stay
        alone = one.where(F.col("__content").isNull())
        one = one.where(F.col("__content").isNotNull()).dropDuplicates(["__content", "doc_id"]).unionByName(alone)
    return one.select(docs.columns)
