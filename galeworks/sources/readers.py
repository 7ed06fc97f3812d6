"""Readers of station, gust, stroke, site and mask files, and the sinks. Text that is no number or time becomes null."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galeworks.functions.exprs import group_id

# The columns of the station and gust files.
STATION = ["id", "stn_no", "district", "stn_name", "site_open", "site_close", "lat", "lon", "latlon_method", "state", "hgt_asl", "hgt_asl_baro", "wmo_idx", "y1", "y2", "comp", "y_pct", "n_pct", "w_pct", "s_pct", "i_pct", "end"]
ONE_STAMP = ["hd", "stn_id", "dt_lt", "dt_utc", "gust", "q", "end"]
SPLIT_STAMP = ["hd", "stn_id", "ly", "lm", "ld", "lh", "lmin", "uy", "um", "ud", "uh", "umin", "gust", "q", "end"]
STROKE_6 = ["date", "time", "lat", "lon", "c5", "c6"]
STROKE_9 = [*STROKE_6, "c7", "c8", "c9"]
MULTISENSOR = ["hd", "stn_no", "dt_lt", "dt_utc", "p", "p_q", "p_p", "t", "t1", "dp", "dp_q", "rh", "rh_q", "ws", "ws_q", "min_ws", "min_ws_q", "wd", "wd_q", "std_wd", "std_wd_q", "wg", "wg_q", "mslp", "mslp_q", "pres", "pres_q", "qnh", "qnh_q", "end"]

#: Form of times in published text.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of spark.checkpoint.dir; a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_table(spark: SparkSession, paths: Sequence[str] | str, names: Sequence[str], header: bool) -> DataFrame:
    """Comma-separated text, every column a trimmed string."""
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(paths, header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def stamp(text: Column, form: str = "yyyyMMddHHmm") -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def read_stations(spark: SparkSession, paths: Sequence[str] | str, header: bool = False) -> DataFrame:
    """Stations of any number of files; whether the first line is a header is said by the caller."""
    raw = text_table(spark, paths, STATION, header).drop("end")
    kinds = {"stn_no": "long", "lat": "double", "lon": "double", "hgt_asl": "double", "hgt_asl_baro": "double", "y1": "int", "y2": "int", "comp": "double", "y_pct": "double", "n_pct": "double", "w_pct": "double", "s_pct": "double", "i_pct": "double"}
    return raw.withColumns({n: F.col(n).try_cast(k) for n, k in kinds.items()})


def read_raw_gusts(spark: SparkSession, paths: Sequence[str] | str, layout: int = 1, header: bool = False) -> DataFrame:
    """Gusts in m/s with UTC and local time; layout 1 has whole stamps, layout 2 split ones and km/h."""
    raw = text_table(spark, paths, ONE_STAMP if layout == 1 else SPLIT_STAMP, header)
    gust = F.col("gust").try_cast("double")
    if layout == 1:
        return raw.select(stamp(F.col("dt_utc")).alias("dt_utc"), F.col("stn_id").try_cast("long").alias("stn_id"), stamp(F.col("dt_lt")).alias("dt_lt"), gust.alias("gust"), "q")
    joined = lambda p: stamp(F.concat(F.lpad(p + "y", 4, "0"), *[F.lpad(p + x, 2, "0") for x in ("m", "d", "h", "min")]))
    return raw.select(joined("u").alias("dt_utc"), F.col("stn_id").try_cast("long").alias("stn_id"), joined("l").alias("dt_lt"), (gust / 3.6).alias("gust"), "q")


def read_strokes(spark: SparkSession, six: Sequence[str], nine: Sequence[str]) -> DataFrame:
    """Lightning strokes of both layouts as (time, lat, lon)."""
    parts = [text_table(spark, list(p), n, False) for p, n in ((six, STROKE_6), (nine, STROKE_9)) if p]
    raw = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    when = F.try_to_timestamp(F.concat_ws(" ", "date", "time")).cast("timestamp_ntz")
    return raw.select(when.alias("time"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))


def read_multisensor(spark: SparkSession, paths: Sequence[str] | str, header: bool = True) -> DataFrame:
    """One-minute files of all sensors: times, and every measured column a number; quality marks (`_q`, `_p`) stay text."""
    marks = {"hd", "end", "dt_lt", "dt_utc", *[n for n in MULTISENSOR if n.endswith(("_q", "_p"))]}
    raw = text_table(spark, paths, MULTISENSOR, header)
    numbers = {n: F.col(n).try_cast("long" if n == "stn_no" else "double") for n in MULTISENSOR if n not in marks}
    return raw.withColumns({**numbers, "dt_utc": stamp(F.col("dt_utc")), "dt_lt": stamp(F.col("dt_lt"))}).drop("hd", "end")


def read_tracks(spark: SparkSession, paths: Sequence[str] | str, schema: str) -> DataFrame:
    """Storm tracks of any number of files with a header, and group_id, which names a storm's scan."""
    t = spark.read.schema(schema).option("timestampNTZFormat", MICROS).csv(paths, header=True)
    return t.withColumn("group_id", group_id(F.col("time"), F.col("uid")))


def grid_slice(grid: DataFrame, place: Sequence[str], time: str, variables: Sequence[str], first: Column, last: Column, hours: Sequence[int] | None = None) -> DataFrame:
    """Some variables of a grid between two times, at some hours of the day (the synoptic ones, say). The time range reaches the scan."""
    cut = grid.where(F.col(time).between(first, last))
    return (cut.where(F.hour(time).isin(*hours)) if hours is not None else cut).select(*place, time, *variables)


def load_grid(spark: SparkSession, paths: Mapping[str, str], place: Sequence[str], time: str, first: Column, last: Column, hours: Sequence[int] | None = None) -> DataFrame:
    """grid_slice of one table a variable, as {variable: path}, joined on time and place."""
    parts = [grid_slice(spark.read.parquet(path), place, time, [name], first, last, hours) for name, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, [*place, time])
    return out


def write_grid_tables(tables: Mapping[str, DataFrame], path: str, place: Sequence[str], time: str, buckets: int) -> dict[str, str]:
    """One table a variable below path, all dealt into the same buckets of place and time and sorted in them: {variable: its name in the session's catalogue}.

    load_grid_tables then joins any number of them without sending a row. `buckets` should leave a few hundred MB of the largest table in each.
    """
    names = {v: f"grid_{v}_{uuid.uuid4().hex}" for v in tables}
    for v, df in tables.items():
        dealt = df.repartition(buckets, *place, time)  # a bucket is one file
        dealt.write.bucketBy(buckets, *place, time).sortBy(*place, time).option("path", f"{path}/{v}").mode("overwrite").saveAsTable(names[v])
    return names


def load_grid_tables(spark: SparkSession, names: Mapping[str, str], place: Sequence[str], time: str, first: Column, last: Column, hours: Sequence[int] | None = None) -> DataFrame:
    """load_grid of tables that write_grid_tables wrote: {variable: name}. Equal buckets meet where they lie."""
    parts = [grid_slice(spark.table(name), place, time, [v], first, last, hours).hint("merge") for v, name in names.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, [*place, time])
    return out


def read_fixed_width(spark: SparkSession, paths: Sequence[str] | str, places: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Trimmed fields of lines, each at (first place from 1, length); empty ones are null."""
    return spark.read.text(paths).select(*[F.nullif(F.trim(F.substring("value", at, n)), F.lit("")).alias(name) for name, (at, n) in places.items()])


def discover_by_filename(spark: SparkSession, folder: str, pattern: str, form: str, first: Column, last: Column) -> DataFrame:
    """(path, time) of files whose name holds a time within [first, last]; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.withColumn("time", stamp(F.regexp_extract("path", pattern, 1), form)).where(F.col("time").between(first, last))


def exclude(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return df.join(bad.select(key), key, "left_anti")


def coverage_check(events: DataFrame, catalogue: DataFrame, key: str, time: str, day: str) -> DataFrame:
    """Events whose key has files on the day of the event and on the day before."""
    on = catalogue.select(key, F.to_date(day).alias("__day")).distinct()
    at = events.withColumn("__day", F.to_date(time))
    return at.join(on, [key, "__day"], "left_semi").join(on.withColumn("__day", F.date_add("__day", 1)), [key, "__day"], "left_semi").drop("__day")


def mask_to_long(df: DataFrame) -> DataFrame:
    """(scan, uid, i, j) of the set cells of masks given as a first row and column (i0, j0) and an array of arrays `cells`."""
    rows = df.select("scan", "uid", "i0", "j0", F.posexplode("cells").alias("di", "row"))
    return rows.select("scan", "uid", "i0", "j0", "di", F.posexplode("row").alias("dj", "set")).where("set = 1").select("scan", "uid", (F.col("i0") + F.col("di")).alias("i"), (F.col("j0") + F.col("dj")).alias("j"))


def hour_index(year: Column, hours: Column) -> Column:
    """Time of an hour counted from the first of January."""
    return F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), hours)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in folders by key; rows meet by key first, so that a folder holds few files; AQE splits large ones.

    A rerun replaces the folders that it has rows for, and leaves all others: new files are staged below path and folders change only when
    all tasks are done, so a job that fails midway leaves the old rows. Keys that a rerun has no row for keep what they had.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What write_partitioned wrote, by the schema it was written with: a table without any row has no file to take one from."""
    return spark.read.schema(schema).parquet(path)


def restructure_by_year(gusts: DataFrame, path: str, state: str, time: str, years: Sequence[int]) -> None:
    """Gusts of all stations in folders by state and year; rows outside the years go."""
    df = gusts.withColumn("year", F.year(time)).where(F.col("year").isin(*years))
    write_partitioned(df, path, [state, "year"])


def write_merged(df: DataFrame, path: str, time: str) -> None:
    """The merged table in folders by radar, year and month."""
    write_partitioned(df.withColumns({"year": F.year(time), "month": F.month(time)}), path, ["rid", "year", "month"])


def write_event_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Events, non-events and the storms of both, each a table in folders by radar."""
    for name, df in tables.items():
        write_partitioned(df, f"{path}/{name}", ["rid"])


def union_radars(spark: SparkSession, path: str, names: Mapping[str, int], schemas: Mapping[str, StructType] | None = None) -> DataFrame:
    """Tables of all radars below path as one, as {name: scw}; rid comes from the folders, scw tells events from non-events. With schemas, by name,
    a table may be without rows."""
    read = lambda name: read_partitioned(spark, f"{path}/{name}", schemas[name]) if schemas and name in schemas else spark.read.parquet(f"{path}/{name}")
    parts = [read(name).withColumn("scw", F.lit(scw)) for name, scw in names.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def publish(df: DataFrame, names: Mapping[str, str], order: Sequence[str], path: str) -> None:
    """Selected columns under their public names, in a whole order, as comma-separated text with a header; times keep their microseconds.

    A rerun replaces the table.
    """
    df.select(*[F.col(a).alias(b) for a, b in names.items()]).orderBy(*order).write.option("timestampNTZFormat", MICROS).mode("overwrite").csv(path, header=True, timestampFormat=MICROS)
