"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of one group (here: of equal text) are linked. Labels start at random; in each round a group's documents
move to the label that most of them have, as far as that shard's quota lets them; the rows without links fill up what
the linked ones leave. A last pass numbers all rows in the order of their labels and cuts that into shards, which makes
row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_count, remove, written

#: Rows of a bucket within which rows are numbered by a sort.
BUCKET_ROWS = 4_000
#: Rows of a group that go to one task of a join.
DEALT_ROWS = 1_000
#: Rounds of propagation at most; it ends before, once no row moves.
ROUNDS = 10


def _uniform(*columns: Column) -> Column:
    """From 0 to 1, by a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def label_propagation(linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked(rid, grp, many)`` with a label each: as few labels in a group as ``quota`` rows a label allow.

    A group that is larger than the quota keeps rows in other shards. Groups of at most a hundredth of the quota move as
    a whole. Within the last rounds' error (quotas are kept by hashed shares, not by counting out) the labels' sizes
    stay under the quota. Equal votes go by a hash. Ends when a round moves nothing, or after ``rounds``.
    """
    before = None
    labels = linked.withColumn("label", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    for turn in range(rounds):
        votes = labels.groupBy("grp", "label").agg(F.count("*").alias("n"))
        # a group larger than the quota aims for half as many labels again as it needs, the most frequent first
        ranked = F.reverse(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("grp", "label").alias("h"), "label"))))["label"]  # a row for each shard
        target = votes.groupBy("grp").agg(ranked.alias("aims"), F.sum("n").alias("all"))
        # rows of a large group are dealt to several tasks, each with the group's aims
        target = target.select("grp", "aims", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / DEALT_ROWS) - 1)).alias("deal"))
        deal = F.pmod(F.xxhash64("rid", F.lit("deal")), F.ceil(F.col("many") / DEALT_ROWS))
        wide = F.when(F.col("many") <= quota, 1).otherwise(F.ceil(F.col("many") * 1.5 / quota)).cast("int")
        aims = F.slice("aims", F.lit(1), F.least(wide, F.size("aims")))
        aim = F.element_at(aims, F.pmod(F.xxhash64("rid", F.lit("aim")), F.size(aims)).cast("int") + 1)
        wish = labels.withColumn("deal", deal).join(target, ["grp", "deal"]).withColumn("to", F.when(F.array_contains(aims, F.col("label")), F.col("label")).otherwise(aim)).drop("aims", "deal")
        stay = F.col("label") == F.col("to")
        flow = wish.groupBy("to").agg(F.count_if(stay).alias("own"), F.count_if(~stay).alias("come"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (quota - F.col("own")) / F.greatest("come", F.lit(1))))
        shares = flow.select("to", share.alias("share"))  # a row for each shard
        mover = F.when(F.col("many") * 100 <= quota, _uniform(F.col("grp"), F.lit(turn))).otherwise(_uniform(F.col("rid"), F.lit(turn)))
        moves = ~stay & (mover < F.col("share"))
        moved = wish.join(F.broadcast(shares), "to").select("rid", "grp", "many", F.when(stay | moves, F.col("to")).otherwise(F.col("label")).alias("label"), moves.alias("moved"))
        labels = written(moved, "labels")
        remove(before)
        before, some = labels, not labels.where("moved").isEmpty()
        labels = labels.drop("moved")
        if not some:
            break
    return labels


def shard(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """Shards for all rows of ``docs(doc_id, text)``: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Size: bytes of the text and 16. Row counts of shards differ by one at most; slots count a shard's rows from 0.
    Null and empty texts are equal texts with no bytes. Rows with equal or null doc_id are rows of their own. Other columns are ignored;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "shard-rows")
    total = rows.count()
    least, over = divmod(total, shards)
    groups = written(rows.groupBy("grp").agg(F.count("*").alias("many")).where("many > 1"), "groups")
    joined = written(join_by_count(rows.select("rid", "grp"), groups, "grp", "many", total).select("rid", "grp", "many"), "linked")
    remove(groups)
    labels = label_propagation(joined, shards, max(1, least), rounds)
    # rows without links: as many to each label as its linked rows leave free
    held = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    free = [max(0, least + (s < over) - held.get(s, 0)) for s in range(shards)]
    ends, at = [], 0
    for n in free:
        at += n
        ends.append(at)
    u = _uniform(F.col("rid"), F.lit("free")) * float(max(1, at))
    filler = F.coalesce(*[F.when(u < float(e), F.lit(s)) for s, e in enumerate(ends)], F.lit(shards - 1))
    own = labels.select(F.col("rid").alias("linked_rid"), F.col("label").alias("linked_label"), "many")
    placed = rows.join(own, F.col("rid") == F.col("linked_rid"), "left")
    # order: label; unlinked rows at both ends, which may slip to the next shard; groups together in the middle
    salt = F.when(F.col("many") > BUCKET_ROWS, F.pmod(F.xxhash64("rid"), F.ceil(F.col("many") / BUCKET_ROWS))).otherwise(0)
    zone = F.when(F.col("many").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("rid", F.lit("zone")), F.lit(2)) * 2)
    width = max(1, total // (shards * BUCKET_ROWS))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "grp", "rid", F.coalesce("linked_label", filler).alias("label"),
        zone.cast("int").alias("zone"), F.pmod("grp", F.lit(width)).cast("int").alias("sub"), salt.cast("int").alias("salt"),
    )
    bucket = ["label", "zone", "sub", "salt"]
    placed = written(placed, "placed")
    remove(rows, joined)
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("n"))
    by_label = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    first, at = {}, 0
    for s in range(shards):
        first[s] = at
        at += by_label.get(s, 0)
    bases = F.array(*[F.lit(first[s]).cast("long") for s in range(shards)])
    before = Window.partitionBy("label").orderBy("zone", "sub", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*bucket, (F.element_at(bases, F.col("label") + 1) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("grp", "rid"))
    numbered = placed.withColumn("rank", rank).join(bases, bucket)
    p = F.col("base") + F.col("rank") - 1
    split = over * (least + 1)
    where = F.when(p < split, F.floor(p / (least + 1))).otherwise(over + F.floor((p - split) / max(1, least)))
    begin = F.when(F.col("shard") < over, F.col("shard") * (least + 1)).otherwise(split + (F.col("shard") - over) * least)
    return (
        numbered.withColumn("shard", where.cast("int")).withColumn("slot", (p - begin).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def cut_groups(assigned: DataFrame, group: str = "text_crc32") -> DataFrame:
    """How far groups are cut: for each group its rows and the shards it lies in."""
    return assigned.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct("shard").alias("n_shards"))
