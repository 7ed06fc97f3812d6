"""Gusts as an unbounded stream: the same columns as the batch forms, state bounded by watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gust_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def hourly_peaks(gusts: DataFrame, keys: Sequence[str], time: str, value: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Peak, mean and number of gusts of each key and hour; rows later than `late` go, and so does the state behind it.

    Also takes a batch, where all rows count.
    """
    w = gusts.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w"))
    return w.agg(F.max(value).alias("peak"), F.avg(value).alias("mean"), F.count(value).alias("n")).select(*keys, F.col("w.start").alias("hour"), "peak", "mean", "n")


def severe_spells(gusts: DataFrame, keys: Sequence[str], time: str, value: str, least: float, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Spells of gusts of at least `least`, apart by less than `gap`: first and last time and peak of each."""
    strong = gusts.where(F.col(value) >= least).withWatermark(time, late)
    found = strong.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.max(value).alias("peak"), F.count("*").alias("n"), F.max(time).alias("last"))
    return found.select(*keys, F.col("w.start").alias("first"), "last", "peak", "n")
