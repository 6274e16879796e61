"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, after A-Z are lower-cased: a run of digits, a-z and everything outside ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_PATTERN)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of an Arrow batch at most.
ARROW_ROWS = 2_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())

#: A side of a join (of a few short columns) is broadcast only if it is proven to have no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. On one machine (tests) it may be unset, and is a temporary one then."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='inkplan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ARROW_ROWS at most from now on: whole texts come in them, to Python and through the JVM's buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def release_memory() -> None:
    """Give a Python worker's free memory back to the machine, at the end of a task: workers are kept for later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of computing it again, also after executors were lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkplan_path = path
    return out


def remove(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more, also not a result that is still to be computed."""
    for df in tables:
        path = getattr(df, "_inkplan_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key with more than this share of the rows is joined by broadcast, not by a shuffle on the key.
HOT_SHARE = 1 / 2000


def join_by_count(rows: DataFrame, lookup: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """rows joined (inner) by ``key`` with lookup, a table of a row for each key that has the number of its rows in ``many``.

    Keys with more than a 2000th of the ``total`` rows, so fewer than 2000, are broadcast, however many rows they have;
    the rows of the others are shuffled. Both tables are read twice.
    """
    hot = F.col(many) > max(1.0, total * HOT_SHARE)
    few = F.broadcast(lookup.where(hot))
    rest = rows.join(F.broadcast(lookup.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(lookup.where(~hot), key))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most that many rows, else df as it is. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_share(*columns: Column) -> Column:
    """From 0 to 1, by a hash: the order in which samples are taken."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def likely_least(share: Column, most: int, total: Column | int) -> Column:
    """Whether a row can be among the ``most`` least shares of ``total`` rows (all but surely).

    Filtered by this, the rows that each task sorts and sends for a sample stay few, however many tasks there are.
    """
    return share <= (2.0 * most + 100) / F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the cheaper lower() where a text is ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """The array of a text's words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def py_words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
