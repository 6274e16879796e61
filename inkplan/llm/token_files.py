"""Token-ID / binary output: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

A file holds consecutive documents in ascending doc_id order::

    magic "IPTOK1\\0\\0" | five uint32: documents, symbols, bytes of control, bytes of data, reserved
    | uint64: tokens | doc_id int64[documents] | doc_id is null uint8[documents] | n_tokens uint32[documents]
    | symbols uint32[symbols]: token id by rank, the file's most frequent first | control bytes | data bytes

All numbers are little-endian. A token is stored as its rank. Two bits of a control byte give the number of data bytes
(1 to 4) of one token, four tokens to a control byte, the first in the lowest bits. Each file has its own rank table
over all its tokens, so a task writes a whole file without waiting for others and a lost task is simply run again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, scratch_path, written
from .tokens import broadcast_tokenizer, default_tokenizer, worker_encoder

MAGIC = b"IPTOK1\0\0"
#: Tokens of a file, about; a task holds them in memory.
FILE_TOKENS = 4 << 20
_HEAD = struct.Struct("<8s5IQ")
#: By control byte: the four lengths it stands for.
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

META = "part int, seq int, path string, n_docs long, n_tokens long"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = n - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), four[np.arange(4) < n[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(n, dtype=np.int64)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - n
    values = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        values |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return values & _MASKS[n]


def file_bytes(doc_ids: list[int | None], token_bytes: list[bytes], dtype: np.dtype) -> bytes:
    """The file's image of documents in that order; token_bytes: each document's ids."""
    lengths = np.array([len(b) // dtype.itemsize for b in token_bytes], "<u4")
    ids = np.frombuffer(b"".join(token_bytes), dtype)
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    for at in range(0, len(ids), 1 << 20):
        counts += np.bincount(ids[at : at + (1 << 20)], minlength=len(counts))
    symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[symbols] = np.arange(len(symbols), dtype=np.uint32)
    parts = [encode_ranks(rank[ids[at : at + (1 << 18)]]) for at in range(0, len(ids), 1 << 18)]
    control, data = (b"".join(p[k] for p in parts) for k in (0, 1))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(symbols), len(control), len(data), 0, len(ids))
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join((head, known.tobytes(), null.tobytes(), lengths.tobytes(), symbols.tobytes(), control, data))


def file_documents(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, each document's number of tokens, and all token ids of a file."""
    magic, docs, symbols, control, data, _, tokens = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, dtype, n, at)
        at += out.nbytes
        return out

    known, null, lengths, by_rank = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", symbols)
    controls, values = take("u1", control), take("u1", data).tobytes()
    ids = np.empty(tokens, np.uint32)
    done = 0
    for first in range(0, tokens, 1 << 20):
        n = min(1 << 20, tokens - first)
        chunk = controls[first // 4 : -(-(first + n) // 4)]
        used = int(_LENGTHS[chunk].reshape(-1)[:n].sum())
        ids[first : first + n] = by_rank[decode_ranks(chunk.tobytes(), values[done : done + used], n)]
        done += used
    return [None if z else int(i) for i, z in zip(known, null, strict=True)], lengths, ids


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files under path; the files' table (part, seq, path, n_docs, n_tokens).

    Null and empty texts have the end id only. Rows with a null doc_id come first; rows with equal doc_id are all
    kept, ordered by their texts' hashes. An empty table has no files. Further columns are ignored. A task keeps about ``file_tokens`` tokens in
    memory and then starts a new file. Each attempt of a task writes under names of its own; only those that the
    returned table names count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = broadcast_tokenizer(spark, tokenizer or default_tokenizer())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(vocabulary.value)
        part = TaskContext.get().partitionId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        ids: list[int | None] = []
        held: list[bytes] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, seq
            name = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{name}.partial") as f:
                f.write(file_bytes(ids, held, encoder.dtype))
            store.move(f"{name}.partial", name)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            prefix = path[: len(path) - len(folder)] if path.endswith(folder) else scheme
            row = {"part": [part], "seq": [seq], "path": [prefix + name], "n_docs": [len(ids)], "n_tokens": [size]}
            ids, held, size, seq = [], [], 0, seq + 1
            release_memory()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                for doc_id, x in zip(piece.column(0).to_pylist(), encoder.documents(piece.column(1), end_id), strict=True):
                    ids.append(doc_id)
                    held.append(x.tobytes())
                    size += len(x)
                    if size >= file_tokens:
                        yield flush()
        if ids:
            yield flush()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # many rows without an id, or with one id, are split by their texts, and equal ones by where they were read
    keyed = rows.withColumns({"__h": F.xxhash64("text"), "__k": F.monotonically_increasing_id()})
    keys = [F.col("doc_id").asc_nulls_first(), F.col("__h"), F.col("__k")]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return written(ordered.mapInArrow(write, META), "token-files")


def read_token_files(files: DataFrame, digest: bool = False) -> DataFrame:
    """Read the files of such a table back: doc_id, start, and ids (array<int>), or with digest n_tokens and ids_crc32.

    start: tokens of all documents before it. ids_crc32: unsigned crc32 of the ids as little-endian uint32.
    """
    by_part = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_start"))  # a row for each partition
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(parts, "part").select("path", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, start long, ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_stream(name) as f:
                    doc_ids, lengths, ids = file_documents(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                first = [pa.array(doc_ids, pa.int64()), pa.array(starts + base, pa.int64())]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*first, pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "start", "ids"])
                del doc_ids, lengths, ids, ends, starts, first
        release_memory()

    tasks = max(1, min(files.count(), 20_000))  # of a written table; a number of its own, or adaptive execution joins them into one task
    return placed.repartition(tasks, "path").mapInArrow(read, schema)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, digest: bool = True) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, scratch_path(spark, "tokens"), tokenizer, end_id), digest)
