"""Operators on ordered rows: lines of texts, times of a key, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_cjk, lines, nfkc, normal_form


def line_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) for each line; a text without lines has no row."""
    return df.select(F.col(id_col), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))


def first_lines(rows: DataFrame, id_col: str, pos: str = "pos", line: str = "line", exact: bool = False) -> DataFrame:
    """Non-blank lines of each text, each only where it first occurs; white space and case don't count.

    `exact` compares their NFKC forms, case-folded; else all is native, which is the same for ASCII texts.
    No fuzzy matching: lines that differ by a sign or a digit are different facts."""
    key = normal_form(F.col(line), exact)
    rows = rows.withColumn("_key", key).where("_key <> ''")
    return rows.groupBy(id_col, "_key").agg(F.min(F.struct(F.col(pos).alias("pos"), F.col(line).alias("line"))).alias("x")).select(id_col, "x.pos", "x.line")


def merge_lines(df: DataFrame, id_col: str, text_cols: list[str], out: str = "text") -> DataFrame:
    """One text for each row from several: lines in order, in NFKC form, without the white space between CJK characters, repeated ones once."""
    whole = F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in text_cols]), "\n")
    rows = line_rows(df.select(id_col, whole.alias("_t")), id_col, "_t")
    rows = rows.withColumn("line", join_cjk(F.regexp_replace(nfkc(F.col("line")), r"(?U)^\s+|\s+$", "")))
    kept = first_lines(rows, id_col, exact=True)
    joined = kept.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias(out))
    return df.select(id_col).join(joined, id_col, "left").select(id_col, F.coalesce(out, F.lit("")).alias(out))


def carry_sections(rows: DataFrame, id_col: str, marker: Column, pos: str = "pos") -> DataFrame:
    """rows with `section`: the last marker at or before the line. A marker of '' ends a section."""
    w = Window.partitionBy(id_col).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m", marker).withColumn("section", F.nullif(F.last("_m", ignorenulls=True).over(w), F.lit(""))).withColumn("is_marker", F.col("_m").isNotNull()).drop("_m")


def context_frame(text: Column, hit, before: int = 2, after: int = 1) -> Column:
    """The lines around the first line that `hit` holds for; null if there is none."""
    arr = lines(text)
    flags = F.transform(arr, hit)
    at = F.array_position(flags, F.lit(True))
    first = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.slice(arr, first.cast("int"), (at + after + 1 - first).cast("int")))


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """df with `recent`: rows of the key in the last `seconds`, the row itself included, one exactly as old excluded."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("recent", F.count("*").over(w))


def gaps(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """df with `gap_us`: microseconds since the key's previous row; null for its first."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("gap_us", us - F.lag(us).over(w))


def first_of_day(df: DataFrame, day: Column, clock: Column, at: str, ts: str, fields: list[str]) -> DataFrame:
    """The first row of each day at or after a time: a trigger that fires once a day and catches up late."""
    return df.withColumns({"_day": day, "_clock": clock}).where(F.col("_clock") >= at).groupBy(F.col("_day").alias("day")).agg(F.min_by(F.struct(ts, *fields), F.struct(ts, *fields)).alias("x")).select("day", "x.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def last_items(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - (k - 1), F.lit(1)), k)


def version_chain(df: DataFrame, key: str, seq: str, version: str) -> DataFrame:
    """df with `parent`: the version before, within the key."""
    return df.withColumn("parent", F.lag(version).over(Window.partitionBy(key).orderBy(seq)))
