"""Sharding by jump consistent hashing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeworks.llm.common import written

#: The generator of the published jump hash.
MULTIPLIER = 2862933555777941757
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key by jump consistent hashing (Lamping and Veach).

    The generator's unsigned 64-bit steps are exact in decimals, since ANSI mode forbids wrapping longs. A null key
    counts as 0. At most `shards` jumps are possible, and steps after the last jump leave the state as it is.
    """
    big, word = F.lit(MULTIPLIER).cast("decimal(19,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long")).cast("decimal(20,0)")
    start = F.struct(F.when(key < 0, key + word).otherwise(key).cast("decimal(20,0)").alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(state: Column, _: Column) -> Column:
        drawn = ((state["key"] * big + F.lit(1)) % word).cast("decimal(20,0)")
        signed = F.when(drawn >= word / 2, drawn - word).otherwise(drawn).cast("long")
        chance = (F.shiftrightunsigned(signed, 33) + 1).cast("double")
        jumped = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / chance)).cast("long")
        return F.when(state["j"] < shards, F.struct(drawn.alias("key"), state["j"].alias("b"), jumped.alias("j"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign_shards(docs: DataFrame, shards: int, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) for every row of docs.

    Slots count from 0 in doc_id order within a shard. So that no shard is ordered in one task, ids are dealt into
    ranges, ranked inside (shard, range), and shifted by the rows of the shard's earlier ranges; the table of shifts has
    shards * buckets rows whatever the input (buckets: as many as the session has shuffle partitions, if not given). Null texts have no bytes (size 16, checksum 0); null ids hash as 0 and
    come first; repeated rows get a slot each. An empty table gives none.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    ranged = written(rows.repartitionByRange(buckets, "doc_id").withColumn("bucket", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("shard", "bucket").count()
    shifts = counts.select("shard", "bucket", F.expr("sum(count) over (partition by shard order by bucket) - count").alias("shift"))
    ranked = ranged.withColumn("place", F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32, size) - 1"))
    return ranked.join(shifts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """Writes the rows of docs in one folder per shard (shard=0 ...)."""
    with_shard = docs.withColumn("shard", jump_shard(F.col("doc_id"), shards))
    with_shard.write.partitionBy("shard").parquet(path)
