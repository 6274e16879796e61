"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplan.llm import decontamination, language_id, line_dedup, near_dup, packing
from inkplan.llm.common import crc_of_id, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is told clearly; those without letters and with narrow margins go.

    A null or empty text has no letters and goes. Texts are told whole, however long. Repeated rows are told alike, each
    row by its text. Rows with a null lang or doc_id are told too; a null doc_id has no fold and is not learned from. An
    empty table stays empty; other columns are kept as they are.
    """
    known = docs.where(crc_of_id(F.col("doc_id")) % 3 != 1).select("text", "lang")
    prediction = language_id.predict(language_id.train(known), F.col("text"))
    return docs.withColumn("__language", prediction).where(~F.col("__language.rejected")).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; n_chars is that of the text that stays.

    All rows stay, also those that become empty. A null text stays null with its n_chars; null sources are one host;
    repeated rows are pages of their own. An empty table stays empty; other columns are kept as they are.
    """
    cleaned = line_dedup.line_dedup(docs, "source", "text")
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies, that of the least doc_id.

    Documents without words (null, empty) all stay. Of repeated rows one stays; a null doc_id comes after all others.
    Long texts are compared whole. An empty table stays empty; other columns are kept as they are.
    """
    return near_dup.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window of any benchmark item.

    A null or empty text holds none and stays, as do all documents if there are no items; an item without words has no
    window. Repeated rows stay or go together; null doc_ids are compared by their texts. Long texts are searched whole.
    An empty table stays empty; other columns are kept as they are.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens.

    A null or empty text is its end token only. Long texts are cut into pieces, of which none is lost. Repeated rows are
    packed each, rows with a null doc_id too. An empty table gives no pieces; other columns do not come along.
    """
    return packing.pack(docs)


STAGES = [
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express compression, sketches and packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
