"""Catalogs and settings: sources that may be read, settings that are loaded once, listings by flags, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a source in the catalog; a message begins as the reason, an address as empty.
SOURCE = "id string, name string, kind string, board string, site string, url string, enabled boolean, status string, reason string"


def source_catalog(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The catalog of sources: SOURCE and message. What a row leaves out is '' (enabled: false)."""
    names = [c.split()[0] for c in SOURCE.split(", ")]
    made = [tuple(r.get(n, False if n == "enabled" else "") for n in names) for r in rows]
    return spark.createDataFrame(made, SOURCE).withColumn("message", F.col("reason"))


def bootstrap(stored: DataFrame, defaults: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """stored, and the defaults of the keys that it doesn't hold; a stored null is a value."""
    return stored.select(key, value).unionByName(defaults.join(stored.select(key), key, "left_anti").select(key, value))


def json_settings(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """(key, value) of JSON files: keys maps each to a file name under path, whose whole text is the value."""
    named = F.create_map(*[F.lit(x) for k, f in keys.items() for x in (f, k)])
    files = spark.read.text([f"{path}/{f}" for f in keys.values()], wholetext=True)
    return files.select(named[F.substring_index(F.input_file_name(), "/", -1)].alias("key"), "value")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one id; no row where there is none."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def flagged(df: DataFrame, flag: str, asked: str | None) -> DataFrame:
    """The flagged rows if `asked` is true or 1, else all; an unknown flag is no flag."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))) if (asked or "").lower() in ("true", "1") else df


def by_city(df: DataFrame, city: str, preferred: str) -> DataFrame:
    """df without samples, with `local`: whether it belongs to the list of the preferred city."""
    return df.where(~F.coalesce(F.col("sample"), F.lit(False))).withColumn("local", F.coalesce(F.col(city).contains(preferred), F.lit(False)))


def chips(text: Column, longest: int = 28, most: int = 3) -> Column:
    """The first short pieces of a text, for display."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n，,；;、]+"), lambda x: F.trim(x))
    return F.slice(F.filter(pieces, lambda x: (x != "") & (F.length(x) < longest)), 1, most)


def kilobytes(size: Column) -> Column:
    """A file's size in whole KB, rounded up."""
    return F.ceil(size / 1024).cast("bigint")


def day_and_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """Month/day hour:minute in a zone, of a UTC time; '' for none."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "MM/dd HH:mm"), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """32 hex digits that are the same for the same parts: an id that a job that runs again doesn't change."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)
