"""Toxicity: a linear classifier over character n-grams scaled by their naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_share, likely_least, written

#: Labelled documents that a classifier is fitted on, at most: those with the least hashes of their ids.
TRAINING_DOCS = 20_000
#: n-grams' lengths, the bits of their hashes, and how many of them, the most telling, the classifier uses.
LENGTHS = (3, 4, 5, 6)
BITS = 22
FEATURES = 4096  # fewer than 65,536
#: Strength of the squared weights' penalty, against one document's loss.
L2 = 1.0
#: Values that are widened at a time when the classifier is fitted.
CHUNK = 1 << 21
_U = np.uint32


def grams(text: str | None) -> np.ndarray:
    """Hashes of a text's character n-grams in order; letters lower-cased, a space at either end."""
    x = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = []
    for n in LENGTHS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ x[j : j + len(h)]) * _U(0x01000193)
            h ^= h >> _U(15)
            h *= _U(0x2C1B3C6D)
            out.append(h >> _U(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    grams: np.ndarray  # hashes of the n-grams that are used
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """A function of texts, with the weights in a table by hash."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.grams] = self.weights

        def scores(texts: list[str | None]) -> np.ndarray:
            z = np.empty(len(texts))
            for k, t in enumerate(texts):
                g = grams(t)
                g = np.unique(g[table[g] != 0])
                z[k] = table[g].sum() + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return scores


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = L2, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression over the features that rows name, each worth its ratio: weights (times the ratio) and bias.

    Newton's method; each step by conjugate gradients. The bias, last in the vectors, is hardly held back. The rows'
    features stay in their two bytes each; they are widened for ``CHUNK`` of them at a time.
    """
    n, f = len(y), len(ratio)
    held = np.append(np.full(f, l2 / n), 1e-6)
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
    cuts = sorted({0, n, *(np.searchsorted(ends, np.arange(CHUNK, ends[-1] if n else 0, CHUNK)) + 1).tolist()})

    def chunks() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Documents, and for each of their features the document (from the first) and the feature."""
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield slice(a, b), np.repeat(np.arange(b - a), [len(r) for r in rows[a:b]]), np.concatenate(rows[a:b]).astype(np.int64)

    def forth(v: np.ndarray) -> np.ndarray:
        own, out = ratio * v[:f], np.empty(n)
        for docs, row, col in chunks():
            out[docs] = np.bincount(row, own[col], docs.stop - docs.start)
        return out + v[f]

    def back(u: np.ndarray) -> np.ndarray:
        out = np.zeros(f)
        for docs, row, col in chunks():
            out += np.bincount(col, u[docs][row], f)
        return np.append(out * ratio, u.sum()) / n

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (held * w * w).sum())

    w = np.zeros(f + 1)
    w[f] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    z = forth(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient, curve = back(p - y) + held * w, p * (1 - p)
        step, rest = np.zeros(f + 1), -gradient
        way, size = rest.copy(), float(rest @ rest)
        if size < 1e-14:
            break
        for _ in range(60):
            bent = back(curve * forth(way)) + held * way
            far = size / float(way @ bent)
            step, rest = step + far * way, rest - far * bent
            new = float(rest @ rest)
            if new < 1e-4 * float(gradient @ gradient):
                break
            way, size = rest + new / size * way, new
        now, move, part = loss(z, w), forth(step), 1.0
        while part > 1e-4 and loss(z + part * move, w + part * step) > now:
            part /= 2
        w, z = w + part * step, z + part * move
    return w[:f] * ratio, float(w[f])


def train(labelled: DataFrame, max_docs: int = TRAINING_DOCS, features: int = FEATURES, min_docs: int = 3) -> Model:
    """A classifier of ``labelled(doc_id, text, label)``; rows with a null label or text are left out.

    Features: the n-grams in ``min_docs`` documents or more whose log-count ratio, the log of the share of label-1
    documents that have it over that of the others, is strongest for their number of documents; of equally strong ones
    those with the least hash. Repeated rows are documents of their own. With one label only or none, also for an empty
    table, all scores are the (smoothed) share of label 1.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select("text", F.col("label").cast("int").alias("label"), hash_share(F.col("doc_id")).alias("h"))
    total = rows.count()
    rows = rows.where(likely_least(F.col("h"), max_docs, total))
    if total > max_docs:
        rows = rows.orderBy("h", "text").limit(max_docs)
    rows = written(rows, "labelled").repartition(F.col("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[int(label > 0), np.unique(grams(text))] += 1
        used = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(used), "no": pa.array(n[0, used].astype(np.int64)), "yes": pa.array(n[1, used].astype(np.int64))})

    sizes = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    no, yes = sizes.get(0, 0), sizes.get(1, 0)
    if not no or not yes:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log((yes + 1) / (no + 1))))
    counts = rows.select("text", "label").mapInArrow(count, "gram long, no long, yes long").groupBy("gram").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    ratio = F.log((F.col("yes") + 1) / (yes + 2)) - F.log((F.col("no") + 1) / (no + 2))
    telling = F.abs("ratio") * F.sqrt(F.col("yes") + F.col("no") * (yes / no))
    best = counts.where(F.col("no") + F.col("yes") >= min_docs).withColumn("ratio", ratio).orderBy(telling.desc(), "gram").limit(features).collect()
    used = np.array([r["gram"] for r in best], np.uint32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            found = [np.unique(p[p >= 0]).astype("<u2").tobytes() for p in (place[grams(t)] for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["label", "h", "grams"])

    # two bytes for each feature of a document: max_docs times features of these at most
    got = rows.select("text", "label", "h").mapInArrow(vectors, "label int, h double, grams binary").toPandas().sort_values(["h", "grams"])
    w, bias = _fit([np.frombuffer(b, "<u2") for b in got["grams"]], (got["label"].to_numpy() > 0).astype(float), np.array([r["ratio"] for r in best]))
    return Model(used, w.astype(np.float32), bias)


def score(model: Model, text: Column) -> Column:
    """Each whole text's score, 0 to 1, however long it is; null and empty texts have that of a text without any n-gram
    of the model. An n-gram counts once for a text; equal texts, also of repeated rows, have equal scores.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = model.scorer()
        for texts in batches:
            yield pd.Series(scores(texts.tolist()))

    return run(text.cast("string"))
