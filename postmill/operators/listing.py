"""Listings, dashboards and records: owner lookups, decoration, order, counters, limits, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_form

#: Input limits of an import (fixed values).
LIMITS = {"text": 100_000, "urls": 12_000, "links": 5, "files": 6, "images": 2, "bytes": 36_000_000}


def owner_of(sources: DataFrame, owners: DataFrame, url: str, source_key: str = "url", ref: str = "owner", key: str = "id") -> DataFrame:
    """The owner rows of one address; filter first, so that only its sources are joined."""
    hit = sources.where(F.col(source_key) == url).select(F.col(ref).alias("_ref"))
    return hit.join(owners, hit["_ref"] == owners[key]).drop("_ref")


def aligned(originals: Column, translations: Column) -> Column:
    """Pairs by position, or null where the counts differ."""
    return F.when(F.size(originals) == F.size(translations), F.arrays_zip(originals.alias("original"), translations.alias("translation")))


def first_eligible(items: Column, is_eligible, fallback: Column) -> Column:
    """The first item that is eligible, else the first of all, else the fallback."""
    return F.coalesce(F.try_element_at(F.filter(items, is_eligible), F.lit(1)), F.try_element_at(items, F.lit(1)), fallback)


def untouched(conditions: list[Column], sources: Column, word: str) -> Column:
    """All conditions hold and every source address has the word; unknown counts as no."""
    every = F.forall(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.contains(word))
    out = F.coalesce(every, F.lit(False))
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def within_limits(sizes: dict[str, Column], limits: dict[str, int] = LIMITS) -> Column:
    """The names of the limits that are exceeded, in the limits' order."""
    return F.array_compact(F.array(*[F.when(sizes[k] > n, F.lit(k)) for k, n in limits.items() if k in sizes]))


def alive(expires: Column, now: Column) -> Column:
    return F.coalesce(expires > now, F.lit(False))


#: Times of day of ISO 8601 in basic and extended form, and offsets.
_CLOCK = r"(?:(?:[01]\d|2[0-3])(?:(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)|(?:[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?))?)"
_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"


def iso_date(text: Column, unknown: str) -> Column:
    """Text of an ISO date or time, Z accepted; '' for unknown, null for what isn't one.

    Calendar dates, week dates and basic forms count, as do hours alone; a time has a real hour, minute and second. Any one character may stand between
    date and time. The text is kept as it is, but for white space around it."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    of = lambda i: F.regexp_extract(plain, rf"^(\d{{4}})(-?)(?:(\d\d)\2(\d\d)|W(\d\d)(?:\2([1-7]))?)(?:[\s\S]{_CLOCK}{_OFFSET})?$", i)
    day = F.try_to_date(F.concat_ws("-", of(1), of(3), of(4)), "yyyy-MM-dd")
    year, week = of(1).cast("int"), of(5).cast("int")
    last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))  # the 28th of December is in the last week
    valid = F.when(of(5) != "", (week >= 1) & (week <= last) & (year > 0)).otherwise(day.isNotNull() & (year > 0))
    return F.when((plain == "") | (plain == unknown), "").when(F.coalesce(valid, F.lit(False)), plain)


def identity(parts: list[Column], unknown: list[str], sample: Column | None = None) -> Column:
    """SHA-256 of the normalised parts joined by |, null if one isn't known; samples have a prefix of their own.

    Parts are compared in NFKC form, case-folded, without white space."""
    plain = [normal_form(p) for p in parts]
    known = F.lit(True)
    for p in plain:
        known = known & ~p.isin("", *unknown)
    digest = F.sha2(F.concat_ws("|", *plain), 256)
    return F.when(known, digest if sample is None else F.concat(F.when(sample, "sample:").otherwise(""), digest))


def recommended_order(in_city: str, confirmed: str, published: str, score: str, seq: str) -> list[Column]:
    """City first, confirmed pay first, latest date as text (unknown last), best score (unknown and 0 as -1), newest."""
    known = F.when(F.coalesce(score, F.lit(0)) == 0, -1).otherwise(F.col(score))
    return [F.desc(in_city), F.desc(confirmed), F.coalesce(F.col(published), F.lit("")).desc(), known.desc(), F.desc(seq)]


def group_counts(df: DataFrame, by: str, groups: list[str]) -> DataFrame:
    """The number of rows of each reported group, 0 where there are none: one column a group, one row."""
    return df.agg(*[F.count_if(F.col(by) == g).alias(g) for g in groups])


def progress(df: DataFrame, key: str, status: str, steps: int) -> DataFrame:
    done = F.count_if(F.col(status) == "completed")
    return df.groupBy(key).agg(done.alias("completed"), F.lit(steps).alias("steps"), F.bround(done * 100.0 / steps, 1).alias("percent"))


def audit_rows(before: DataFrame, key: str, seq: str) -> DataFrame:
    """A snapshot of each row as it was, to append to the log."""
    rest = [c for c in before.columns if c not in (key, seq)]
    return before.select(key, seq, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("snapshot"))


def decorate(rows: DataFrame, stored: DataFrame, key: str, computed: dict[str, Column], hide: list[str]) -> DataFrame:
    """rows with the stored analysis of each, computed where none is stored, and without the hidden columns."""
    s = stored.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in computed])
    joined = rows.join(s, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", value) for c, value in computed.items()}).drop("_key", *[f"_{c}" for c in computed], *hide)
