"""Files as tables of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_lenient, decode_strict, file_name, output_name
from ..operators.detect import HEADER_BYTES, PICKED, detect_format, is_url_name


def scan(spark: SparkSession, path: str, picked_only: bool = True) -> DataFrame:
    """inputs(name, path, size_bytes, content, format) of the files under path, those with a known extension only unless told otherwise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if picked_only:
        files = files.where(F.lower(F.regexp_extract("path", r"\.(\w+)\z", 1)).isin(*PICKED))
    return as_inputs(files)


def as_inputs(files: DataFrame) -> DataFrame:
    """inputs of rows of the binaryFile source."""
    name = file_name(F.col("path"))
    return files.select(name.alias("name"), "path", F.col("length").alias("size_bytes"), "content", detect_format(name, F.col("content")).alias("format"))


def headers(inputs: DataFrame) -> DataFrame:
    """inputs with no more of their content than detection needs."""
    return inputs.withColumn("content", F.substring("content", 1, HEADER_BYTES))


def accept_dropped(uris: DataFrame) -> DataFrame:
    """Of ``uris(uri)``, local paths: path, name. Web addresses and names that look like ones are refused."""
    path = F.url_decode(F.regexp_replace("uri", "^file://", ""))
    return uris.where(~is_url_name(F.col("uri"))).select(path.alias("path"), file_name(path).alias("name")).where(~is_url_name(F.col("name")))


def dedupe(inputs: DataFrame, order: str = "seq") -> DataFrame:
    """The first by ``order`` of inputs with one key: the path, or name and size where there is none."""
    key = F.coalesce("path", F.concat_ws(":", "name", F.coalesce(F.col("size_bytes").cast("string"), F.lit("null"))))
    first = F.min_by(F.struct(*[F.col(c) for c in inputs.columns]), order)
    return inputs.groupBy(key.alias("dedupe_key")).agg(first.alias("r")).select("dedupe_key", "r.*")


def with_output_names(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("output_name", output_name(F.col("name")))


def decoded(inputs: DataFrame, strict: bool = False) -> DataFrame:
    """inputs with text; strict leaves it null where content isn't valid UTF-8 (but for text, Markdown and CSV, which fall back)."""
    lenient = decode_lenient(F.col("content"))
    text = F.when(F.col("format").isin("text", "markdown", "csv"), lenient).otherwise(decode_strict(F.col("content"))) if strict else lenient
    return inputs.withColumn("text", text)
