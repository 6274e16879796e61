"""Sinks of finished Markdown."""

from __future__ import annotations

import contextlib
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the folder in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def write_files(jobs: DataFrame, folder: str, target: Callable[[str], tuple[fs.FileSystem, str]] = store_of) -> DataFrame:
    """Write the content of done jobs to a file each, named by doc_id and output_name, in a folder all executors share: doc_id, path, n_bytes.

    A file is written beside its place and then moved there, so that a reader, or a task that runs again, meets whole
    files only. UTF-8 with line feeds as they are. ``target`` may be another function from the folder's address to a
    file system and a folder in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = target(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            ids, names, texts = (c.to_pylist() for c in batch.columns)
            paths, sizes = [], []
            for doc_id, name, text in zip(ids, names, texts, strict=True):
                path = f"{at}/{doc_id}-{os.path.basename(name)}"
                data = text.encode()
                part = f"{path}.{uuid.uuid4().hex}.partial"
                try:
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, path)
                except BaseException:
                    with contextlib.suppress(OSError):
                        store.delete_file(part)
                    raise
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "path", "n_bytes"])

    done = jobs.where("status = 'done'").select(F.col("doc_id").cast("long"), "output_name", F.coalesce("content", F.lit("")).alias("content"))
    return done.mapInArrow(run, "doc_id long, path string, n_bytes long")


def unique_outputs(jobs: DataFrame) -> DataFrame:
    """output_name, content of done jobs; of equal names the last by doc_id."""
    done = jobs.where("status = 'done' and content is not null")
    return done.groupBy("output_name").agg(F.max_by("content", "doc_id").alias("content"))


def zip_bytes(jobs: DataFrame) -> bytes:
    """A zip archive of all outputs, made on the driver a partition at a time: for batches that a person downloads, not for a corpus."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in unique_outputs(jobs).orderBy("output_name").toLocalIterator():
            z.writestr(r["output_name"], r["content"])
    return out.getvalue()
