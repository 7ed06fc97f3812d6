"""Shared pieces: table access, tables written to the shared folder, connected components."""

from __future__ import annotations

import math
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits, as a power of two, of the tables that slot_filter sends to all executors: 2**20 rows of 64 bits.
SLOT_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is set only where none is named and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that `written` gave, once nothing reads it any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        gateway = df.sparkSession.sparkContext._jvm
        place = gateway.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def marked_slots(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(word, bits) of a table of 2**k bits in which each key's slot is set, and k.

    There are 32 bits a key, up to 2**SLOT_BITS in all; from then on the table fills up, and lets more pass. Its size is bounded.
    """
    keys = keys.select(column)
    k = min(SLOT_BITS, max(10, math.ceil(math.log2(keys.count() + 1)) + 5))
    slot = F.xxhash64(column).bitwiseAND(F.lit((1 << k) - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")), k


def slot_filter(rows: DataFrame, marked: tuple[DataFrame, int], column: str) -> DataFrame:
    """The rows whose key's slot is set: all rows with one of the keys, and few others. No row is sent anywhere for it."""
    words, k = marked
    slot = F.xxhash64(column).bitwiseAND(F.lit((1 << k) - 1))  # never null, so no check for nulls computes the key anew
    looked = rows.withColumns({"__word": F.shiftright(slot, 6), "__bit": (slot.bitwiseAND(F.lit(63))).cast("int")})
    found = looked.join(F.broadcast(words), "__word").where("(shiftright(__bits, __bit) & 1L) = 1L")
    return found.drop("__word", "__bits", "__bit")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are. Texts of ASCII alone take the faster way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node that has a link to another.

    Alternating large-star and small-star rounds until nothing changes, some log(n) squared of them at most; each round is written
    to the shared folder, the one before deleted, and both compared through two sums, so neither links nor components reach the
    driver. Self links and nulls are ignored.
    """
    links = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = written(links.where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, links = links, written(small.where("u <> v").distinct(), "links")
        discard(old)
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
