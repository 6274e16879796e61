"""Best-fit packing: large-item matching, then best fit of the rest into the remaining gaps.

Pieces of one length are alike, so the packing is decided over the histogram of lengths (at most ``capacity`` rows,
whatever the input's size) on the driver, in bulk: a step gives a run of pieces of one length to a run of sequences.
The pieces then find their sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, written
from .tokens import broadcast_tokenizer, default_tokenizer, worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, lrank long"


def pack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, pieces per sequence, first sequence, offset) for so many pieces of each length.

    Pieces above a third of the capacity first: the longest takes the longest that fits beside it, two at most in a
    sequence. Then the smaller ones, longest first, each into the smallest gap it fits, a new sequence if there is none.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    order: list[int] = []  # gaps in use, ascending
    sequences = 0

    def opened(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    def placed(length: int, per: int, first: int, n: int, offset: int, pieces: int | None = None) -> None:
        k = per * n if pieces is None else pieces
        steps.append((length, rank[length], k, per, first, offset))
        rank[length] += k
        left[length] -= k

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while at >= 0 and (not left[large[at]] or large[at] == n and left[n] < 2):
                at -= 1
            if at < 0:
                first, k, gap = sequences, left[n], capacity - n
                placed(n, 1, first, k, 0)
            else:
                p = large[at]
                k = left[n] // 2 if p == n else min(left[n], left[p])
                first, gap = sequences, capacity - n - p
                placed(n, 1, first, k, 0)
                placed(p, 1, first, k, n)
            sequences += k
            opened(gap, first, k)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):  # a run of new sequences
                per = capacity // n
                opened(capacity, sequences, max(1, left[n] // per))
                sequences += max(1, left[n] // per)
                at = bisect.bisect_left(order, n)
            gap = order[at]
            first, many = gaps[gap].pop()
            per = min(gap // n, left[n])
            k = min(many, left[n] // per)
            if k < many:
                gaps[gap].append((first + k, many - k))
            if not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
            placed(n, per, first, k, capacity - gap)
            opened(gap - per * n, first, k)
    return steps


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, with the task (pid) that made it and its rank there among those of its length (lrank)."""
    bounded_batches(docs.sparkSession)
    vocabulary = broadcast_tokenizer(docs.sparkSession, tokenizer or default_tokenizer())
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(vocabulary.value)
        pid = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list[int]] = [[] for _ in range(6)]
                for row, x in enumerate(encoder.documents(part.column(1), end_id)):
                    ids = x.astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        x = ids[start : start + capacity]
                        for column, v in zip(out, (row, piece, start, len(x), zlib.crc32(x.tobytes()), ranks[len(x)]), strict=True):
                            column.append(v)
                        ranks[len(x)] += 1
                row, piece, start, length, crc, lrank = out
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([pid] * len(row), pa.int32()), pa.array(lrank, pa.int64())],
                    names,
                )
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place ``pieces`` (of a written table, as token_pieces() gives them) into sequences: adds sequence_id and offset."""
    by_task = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps = sorted(pack_plan(counts, capacity))
    plan = pieces.sparkSession.sparkContext.broadcast(np.array(steps or [(0,) * 6], np.int64))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("lrank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, per, sequence, offset = plan.value.T
        key = length << 46 | first
        for batch in batches:
            n, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, n << 46 | r, side="right") - 1
            k = r - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + k // per[at]), pa.array(offset[at] + k % per[at] * n)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]
    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens; a row for each piece.

    A document is its ids and the end id; a null or empty text is the end id only. Longer documents are cut into
    pieces of ``capacity`` tokens, the last may be shorter. Rows are packed each on its own, also those with equal or
    null doc_id; further columns are ignored; an empty table gives no rows. Ties between pieces of one length go by
    the place at which they were read.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
