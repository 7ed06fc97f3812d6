"""Exact dedup with a log-structured merge index of digests (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeworks.llm.common import ascii_lower, marked_slots, new_path, slot_filter, written

#: Rows of a memtable, that is, of one sorted run file.
MEMTABLE = 1_000_000
#: Ranges of digests that level 1 is kept in; a compaction rewrites only those that new runs fall into.
RANGES = 64
#: Digests that a lookup of few asks for one by one, so that runs answer from their statistics and filters.
FEW = 64
#: Parquet's own filters on the digest column of each run.
FILTERS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def range_of(digest: Column) -> Column:
    """The range of a digest: its first byte, scaled to RANGES."""
    return F.floor(F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") * RANGES / 256).cast("int")


class DigestIndex:
    """Digests with their kept id and number of rows, in a folder that all executors share.

    add() flushes a batch to level 0: each write task sorts its rows and cuts them into memtables of `memtable` rows, one
    run file each, without any shuffle; a run carries the statistics and a Bloom filter of its digests. compact() merges the
    runs that came since the last time with level 1, range by range; level 1 holds (digest, keep_id, group_size) once
    a digest, sorted by digest. The list of ranges (RANGES entries) is all that the driver holds. find() looks digests up
    in level 1: few of them by ranges, statistics and filters alone, many by a join.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "largest", memtable: int = MEMTABLE):
        self.spark, self.path, self.keep, self.memtable = spark, path or new_path(spark, "digests"), keep, memtable
        self.batches, self.merged, self.ranges = 0, 0, {}

    def add(self, digests: DataFrame) -> DataFrame:
        """Flushes a batch (digest, doc_id) and gives it back as its runs."""
        run = f"{self.path}/level0/run={self.batches}"
        rows = digests.select("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
        rows.write.options(**FILTERS).option("maxRecordsPerFile", self.memtable).parquet(run)
        self.batches += 1
        return self.spark.read.schema(rows.schema).parquet(run)

    def level1(self, ranges: list[int] | None = None) -> DataFrame:
        """digest, keep_id and group_size of all ranges, or of some."""
        paths = [f"{self.path}/level1/version={v}/range={r}" for r, v in sorted(self.ranges.items()) if ranges is None or r in ranges]
        schema = "digest binary, keep_id long, group_size long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> DataFrame:
        """Merges level-0 runs not merged yet into the ranges of level 1 that they fall into."""
        runs = [f"{self.path}/level0/run={k}" for k in range(self.merged, self.batches)]
        if runs:
            new = self.spark.read.parquet(*runs).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
            touched = sorted(r[0] for r in new.select(range_of(F.col("digest"))).distinct().collect())  # at most RANGES
            best = F.max("keep_id") if self.keep == "largest" else F.min("keep_id")
            both = new.unionByName(self.level1(touched)) if set(touched) & set(self.ranges) else new
            level = both.groupBy("digest").agg(best.alias("keep_id"), F.sum("group_size").alias("group_size"))
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            level = level.repartitionByRange(parts, "digest").withColumn("range", range_of(F.col("digest"))).sortWithinPartitions("range", "digest")
            level.write.options(**FILTERS).partitionBy("range").parquet(f"{self.path}/level1/version={self.batches}")
            self.ranges |= dict.fromkeys(touched, self.batches)
            self.merged = self.batches
        return self.level1()

    def find(self, digests: DataFrame) -> DataFrame:
        """digests (digest, ...) with keep_id and group_size of level 1, null where it does not hold the digest."""
        asked = digests.select("digest").where("digest is not null").distinct().limit(FEW + 1).collect()
        if len(asked) > FEW:
            return digests.join(self.level1(), "digest", "left")
        if not asked:
            return digests.join(self.level1([]), "digest", "left")
        level = self.level1(sorted({r["digest"][0] * RANGES // 256 for r in asked}))
        return digests.join(level.where(reduce(Column.__or__, [F.col("digest") == F.lit(bytes(r["digest"])) for r in asked])), "digest", "left")


def dedup_exact(docs: DataFrame, keep: str = "largest", index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with the largest
    (or smallest) doc_id stays. Null ids never win unless a whole group has none: then keep_id is null and its rows are
    kept. Rows that repeat an id are all kept or all dropped. An empty table gives none. Rows of an index that is given count as well.

    Digests recur or not by the index's level 1. Of the texts, those whose digest recurs among these rows are read again and
    compared byte by byte; a table of bits of the recurring digests, of bounded size, keeps nearly all others
    from being sent anywhere. Texts that share a digest but not their bytes form groups of their own.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    index = index or DigestIndex(docs.sparkSession, keep=keep)
    rows = index.add(docs.select("doc_id", digest.alias("digest")))
    shared = index.compact().where("group_size > 1")
    read = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    read = slot_filter(read, marked_slots(shared, "digest"), "digest")
    # Grouping by the bytes themselves is the verification; equal texts meet in one row per task before the shuffle.
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    classes = read.groupBy("digest", "body").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    forked = written(classes.groupBy("digest").count().where("count > 1").select("digest"), "forked")
    if forked.isEmpty():
        out = rows.join(shared, "digest", "left")
    else:
        apart = read.join(forked, "digest", "left_semi").join(classes, ["digest", "body"]).select("digest", "doc_id", "keep_id", "group_size")
        out = rows.join(forked, "digest", "left_anti").join(shared, "digest", "left").unionByName(apart)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
