"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

The forest is fitted on a bounded sample; its depth follows the number of rows, so that leaves keep their size, and all
rows are put into the leaves of each tree. A query visits leaves of all trees in the order of how far it lies from the
splits on their other side. How many rows it has to visit for the target recall is calibrated with some queries that are
compared with all rows. In each visited leaf distances are exact; the results of all leaves are reranked by them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hash_share, likely_least, release_memory, remove, written

#: Vectors that the forest is fitted on, at most: those with the least hashes.
SAMPLE = 20_000
#: Components of the sample, and of a leaf that one task searches at once, at most: long vectors are fewer.
VALUES = 4 << 20
#: Queries that the rows to visit are calibrated with, from that sample.
CALIBRATED = 100
TREES = 8
#: Rows of a leaf, about, as far as MAX_DEPTH allows.
LEAF = 256
MAX_DEPTH = 14
#: Rows of the sample that a node's own threshold needs; deeper nodes split at their level's median.
LEAST_SPLIT = 8
#: Rows of a leaf that one task searches at once; larger leaves are dealt to several.
BLOCK = 8192
#: Queries of a leaf that one task searches at once, about; rows are copied for each block of so many.
QUERIES = 50_000
#: Recall that the number of rows to visit is calibrated for.
TARGET_RECALL = 0.95
SCHEMA = "query_id long, rank int, vec_id long, score double"


def valid(v: Column) -> Column:
    """Not null, not zero, without null and non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Forest:
    """Trees of one depth: a direction for each level of a tree, a threshold for each node."""

    directions: np.ndarray  # (trees, depth, dim)
    thresholds: np.ndarray  # (trees, 2**depth - 1), in heap order

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): the leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t, (d, th) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            p, node = x @ d.T, np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + 1 + (p[:, level] >= th[node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def visit(self, x: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(tree, leaf, rows visited so far with it, by counts (trees, leaves)) of leaves with rows, in the order of the queue."""
        p = np.einsum("tld,d->tl", self.directions, x).tolist()
        inner, got = (1 << self.depth) - 1, 0
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        while queue:
            far, t, node, level = heapq.heappop(queue)
            if node >= inner:
                n = int(counts[t, node - inner])
                if n:
                    got += n
                    yield t, node - inner, got
                continue
            off = p[t][level] - self.thresholds[t, node]
            near = 2 * node + 1 + (off >= 0)
            heapq.heappush(queue, (far, t, near, level + 1))
            heapq.heappush(queue, (far + off * off, t, 4 * node + 3 - near, level + 1))


def fit(sample: np.ndarray, trees: int = TREES, depth: int = 0, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    directions = rng.normal(size=(trees, depth, dim))
    for t in range(trees):  # of one tree's directions, each takes what the ones before it left
        q = np.linalg.qr(directions[t, : min(depth, dim)].T)[0].T
        directions[t, : len(q)] = q
        directions[t] /= np.maximum(np.linalg.norm(directions[t], axis=1, keepdims=True), 1e-12)
    thresholds = np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        p, node = sample @ directions[t].T, np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            thresholds[t, first : 2 * first + 1] = np.median(p[:, level])
            order = np.argsort(node, kind="stable")
            nodes, starts = np.unique(node[order], return_index=True)
            for n, own in zip(nodes.tolist(), np.split(p[order, level], starts[1:]), strict=True):
                if len(own) >= LEAST_SPLIT:
                    thresholds[t, n] = np.median(own)
            node = 2 * node + 1 + (p[:, level] >= thresholds[t, node])
    return Forest(directions, thresholds)


def depth_for(rows: int, leaf: int = LEAF) -> int:
    return min(MAX_DEPTH, max(0, round(np.log2(max(1, rows / leaf)))))


def rows_to_visit(forest: Forest, counts: np.ndarray, queries: np.ndarray, near: list[np.ndarray], target: float = TARGET_RECALL) -> tuple[float, float]:
    """How many rows of all trees a query visits until it has met that share of its neighbours, and in how many leaves.

    near: for each query the leaves (neighbours, trees) of its true neighbours.
    """
    needed: list[int] = []
    leaves: list[int] = []
    for x, own in zip(queries, near, strict=True):
        wanted: dict[tuple[int, int], list[int]] = {}
        for i, places in enumerate(own.tolist()):
            for t, leaf in enumerate(places):
                wanted.setdefault((t, leaf), []).append(i)
        left = set(range(len(own)))
        for n, (t, leaf, got) in enumerate(forest.visit(x, counts), 1):
            met = left.intersection(wanted.get((t, leaf), ()))
            needed += [got] * len(met)
            leaves += [n] * len(met)
            left -= met
            if not left:
                break
    return (float(np.quantile(needed, target)), float(np.quantile(leaves, target))) if needed else (np.inf, np.inf)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, sample: int = SAMPLE, trees: int = TREES, target: float = TARGET_RECALL, leaf: int = LEAF) -> DataFrame:
    """The k nearest found of ``vectors(vec_id, embedding)`` for each row where ``queries`` holds: query_id, rank, vec_id, score.

    score: the Euclidean distance in double precision. Candidates: all rows but those with the query's own vec_id, as
    far as their vectors are of the query's length. Equal distances go by vec_id. Vectors that are null, zero or hold
    null or non-finite components, and rows with a null vec_id take no part. Equal rows count once; equal vectors are
    kept together with the k + 1 least of their ids, which is all that can be among k nearest. Long vectors are
    compared whole. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    # each different vector once: first within a partition's batches, then over all
    ids = written(rows.select("v", "vec_id", F.xxhash64("v").alias("h")).mapInArrow(_least_ids(k + 1), "h long, v array<double>, ids array<long>"), "vectors")
    w = Window.partitionBy("h", "v").orderBy("id")
    hot = ids.groupBy("h").count().where("count > 1").select("h")
    repeated = ids.join(hot, "h", "left_semi").select("h", "v", F.explode("ids").alias("id")).distinct()
    merged = repeated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).groupBy("h", "v").agg(F.collect_list("id").alias("ids"))
    distinct = written(ids.join(hot, "h", "left_anti").select("h", "v", "ids").unionByName(merged.select("h", "v", "ids")), "distinct-vectors")
    remove(ids)
    out = None
    for size in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row for each length
        same = F.size("v") == size["dim"]
        found = _nearest(distinct.where(same), size["n"], rows.where(F.col("asks") & same).select("vec_id", "v").distinct(), size["dim"], k, sample, trees, target, leaf)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _nearest(distinct: DataFrame, total: int, asking: DataFrame, dim: int, k: int, sample: int, trees: int, target: float, leaf: int) -> DataFrame:
    """nearest() over ``total`` different vectors of one length; ``distinct(h, v, ids)``, ``asking(vec_id, v)``."""
    spark = distinct.sparkSession
    sample, block = (max(1, min(most, VALUES // dim)) for most in (sample, BLOCK))
    order = hash_share(F.col("h"))
    picked = distinct.where(likely_least(order, sample, total)).select("v", order.alias("o")).orderBy("o", "v").limit(sample)
    fitted = _matrix(picked.select("v").toArrow().column(0).combine_chunks(), dim)
    forest = fit(fitted, trees, depth_for(total, leaf))
    some = fitted[:CALIBRATED]
    shared = spark.sparkContext.broadcast((forest, some))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows in each leaf (q null), and for each calibrated query its nearest ones there."""
        f, ask = shared.value
        n = np.zeros((len(f.directions), 1 << f.depth), np.int64)
        best: list[list[tuple[float, list[int]]]] = [[] for _ in ask]
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            own = f.leaves(x)
            for t in range(len(n)):
                n[t] += np.bincount(own[:, t], minlength=n.shape[1])
            for q, d in enumerate(_square_distances(ask, x)):
                top = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                best[q] = sorted(best[q] + list(zip(d[top].tolist(), own[top].tolist(), strict=True)))[: k + 1]
        t, at = np.nonzero(n)
        first = pa.RecordBatch.from_pydict({"t": t, "leaf": at, "n": n[t, at]})
        yield pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.float64()), pa.nulls(len(t), pa.list_(pa.int64())), *first.columns], ["q", "d", "own", "t", "leaf", "n"])
        found = [(q, d, own) for q, b in enumerate(best) for d, own in b]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(found), pa.int64())] * 3], ["q", "d", "own", "t", "leaf", "n"])
        release_memory()

    surveyed = written(distinct.select("v").mapInArrow(survey, "q int, d double, own array<long>, t long, leaf long, n long"), "survey")
    counts = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in surveyed.where("q is null").groupBy("t", "leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf
        counts[r["t"], r["leaf"]] = r["n"]
    place_of = F.row_number().over(Window.partitionBy("q").orderBy("d", "own"))
    near: list[list[list[int]]] = [[] for _ in some]
    for r in surveyed.where("q is not null").withColumn("place", place_of).where(F.col("place") <= k + 1).select("q", "own").collect():  # k + 1 for each calibrated query
        near[r["q"]].append(r["own"])
    remove(surveyed)
    rows_needed, leaves_needed = rows_to_visit(forest, counts, some, [np.array(x) for x in near], target)
    # of all trees together at least so many that one tree gives k + 1
    enough = max(rows_needed, trees * (k + 1))
    blocks = np.maximum(1, -(-counts // block))
    # queries of a leaf are searched in blocks as well, each with all of the leaf's rows
    share = min(1.0, leaves_needed / counts.size)
    ways = max(1, int(-(-asking.count() * share // QUERIES)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, _ = shared.value
        for batch in batches:
            leaves, h = f.leaves(_matrix(batch.column(1), dim)), batch.column(0).to_numpy()
            for t in range(leaves.shape[1]):
                bucket = (t << f.depth | leaves[:, t]) << 24 | np.abs(h) % blocks[t, leaves[:, t]]
                for way in range(ways):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([way] * len(h), pa.int32()), batch.column(1), batch.column(2)], ["bucket", "way", "v", "ids"])
        release_memory()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, _ = shared.value
        for batch in batches:
            for i, x in enumerate(_matrix(batch.column(1), dim)):
                to = []
                for t, at, got in f.visit(x, counts):
                    to += [(t << f.depth | at) << 24 | b for b in range(blocks[t, at])]
                    if got >= enough:
                        break
                one = pa.array([i] * len(to), pa.int64())
                asks = batch.column(0).take(one)
                way = pa.array(asks.to_numpy() // 7 % ways, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), way, asks, batch.column(1).take(one)], ["bucket", "way", "query_id", "q"])
        release_memory()

    leaves = distinct.select("h", "v", "ids").mapInArrow(place, "bucket long, way int, v array<double>, ids array<long>")
    asked = asking.mapInArrow(route, "bucket long, way int, query_id long, q array<double>")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x, q = (_matrix(side.column(name).combine_chunks(), dim) for side, name in ((left, "v"), (right, "q")))
            lists = left.column("ids").combine_chunks()
            every, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())
            names = right.column("query_id").to_numpy()
            for begin in range(0, len(q), step := max(1, (1 << 22) // len(x))):
                for name, query, d in zip(names[begin : begin + step].tolist(), q[begin : begin + step], _square_distances(q[begin : begin + step], x), strict=True):
                    # those that may be among the k nearest, whatever rounding did; then their exact distances
                    some = np.flatnonzero(d <= np.partition(d, k)[k] * (1 + 1e-9) + 1e-12 * (query @ query)) if len(d) > k + 1 else np.arange(len(d))
                    exact = np.sqrt(((x[some] - query) ** 2).sum(1))
                    keep = np.isin(at, some)
                    e, dd = every[keep], exact[np.searchsorted(some, at[keep])]
                    dd, e = dd[e != name], e[e != name]
                    best = np.lexsort((e, dd))[:k]
                    out.append((np.full(len(best), name), e[best], dd[best]))
        columns = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns), strict=True)))

    found = leaves.groupBy("bucket", "way").cogroup(asked.groupBy("bucket", "way")).applyInArrow(search, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _square_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, rows): squared distances, but for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
    return np.maximum(np.where(np.isfinite(d), d, np.inf), 0.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _least_ids(k: int):
    """Of rows (v, vec_id, h): for each vector among a task's batch the k least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, tuple[int, set]] = {}
            width = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            flat = (batch.column(0).flatten().to_numpy(zero_copy_only=False) + 0.0).astype("<f8")  # -0.0 is 0.0
            ends = np.cumsum(width)
            for i, (end, n, vec_id) in enumerate(zip(ends.tolist(), width.tolist(), batch.column(1).to_pylist(), strict=True)):
                ids.setdefault(flat[end - n : end].tobytes(), (i, set()))[1].add(vec_id)
            first = pa.array([i for i, _ in ids.values()], pa.int64())
            least = [sorted(s)[:k] for _, s in ids.values()]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(first), batch.column(0).take(first), pa.array(least, pa.list_(pa.int64()))], ["h", "v", "ids"])

    return run
