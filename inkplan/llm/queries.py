"""The operators' queries over the tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, language_id, license_scan, line_dedup, near_dup, packing, sharding, token_files, toxicity
from .common import crc_of_id, hash_share, likely_least, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_of_id(F.col("doc_id")) % 3
    dictionaries = language_id.train(docs.where(fold != 1).select("text", "lang"))
    out = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), language_id.predict(dictionaries, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.*")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.build_index(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(spark, table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs, counts=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_of_id(F.col("doc_id")) % 5
    known = labels.where((fold != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    h = hash_share(F.col("doc_id"))
    known = known.where(likely_least(h, toxicity.TRAINING_DOCS, known.count())).orderBy(h, "label").limit(toxicity.TRAINING_DOCS)
    model = toxicity.train(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"))
    out = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_nearest_neighbours, op3_sharding, op4_license_scan, op5_decontamination,
        op6_token_files, op7_near_duplicates, op8_line_dedup, op9_packing, op10_toxicity, pipeline,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
wins as (select distinct item_id, list_slice(w, s, s + least(8, len(w)) - 1) as win
         from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as s from i where len(w) > 0)),
sizes as (select distinct len(win) as n from wins),
grams as (select r, s, n, list_slice(w, s, s + n - 1) as win
          from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
hits as (select g.r, g.s, g.n, v.item_id from grams g join wins v on g.win = v.win),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from hits) group by r),
found as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join covered using (r) left join found using (r)
""",
    "op8_line_dedup": """
with d as (select row_number() over () as r, doc_id, source, text, string_split(text, chr(10)) as lines from documents),
each as (select distinct r, source, trim(l) as l from (select r, source, unnest(lines) as l from d) where trim(l) <> ''),
total as (select source, count(*) as pages from d group by source),
bad as (select e.source, e.l from each e join total t on e.source is not distinct from t.source
        group by e.source, e.l, t.pages having count(*) >= 2 and count(*) > 0.05 * t.pages),
lists as (select source, list(l) as bad from bad group by source),
kept as (select doc_id, d.source, lines, text, list_filter(lines, lambda x: trim(x) = '' or not list_contains(coalesce(bad, []), trim(x))) as k
         from d left join lists on d.source is not distinct from lists.source)
select doc_id, source, array_to_string(k, chr(10)) as text, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(k), 0) as n_dropped
from kept
""",
}
