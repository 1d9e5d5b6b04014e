"""Listing, dashboard and the daily shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, serialised: Column | None = None) -> DataFrame:
    """Rows whose whole serialised content, names included, contains the text; case is ignored, '' finds all."""
    if not text:
        return df
    whole = serialised if serialised is not None else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.where(F.lower(whole).contains(text.lower()))


def equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; an empty one is none."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == value) if value not in (None, "") else df
    return df


def order(df: DataFrame, by: str, seq: str = "seq", score: str = "score", salary: str = "min_monthly", updated: str = "updated_at") -> DataFrame:
    """score / match, salary, updated; anything else is newest first. Null and 0 rank as -1; ties newest first."""
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(-1)).desc()
    key = {"score": value(score), "match": value(score), "salary": value(salary), "updated": F.col(updated).desc()} if by in ("score", "match", "salary", "updated") else {}
    return df.orderBy(*([key[by]] if by in key else []), F.desc(seq))


def open_posting(sample: Column, closed: Column, status: Column, pay_below: Column, done: list[str]) -> Column:
    return ~sample & ~closed & ~status.isin(done) & ~pay_below


def dashboard(df: DataFrame, status: str, states: list[str], day: Column, today: Column) -> DataFrame:
    """One row: total, new_today, and a count for each reported state."""
    return df.agg(F.count("*").alias("total"), F.count_if(day == today).alias("new_today"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states])


def digest(candidates: DataFrame, ledger: DataFrame, key: str, ranking: list[Column], k: int = 12) -> DataFrame:
    """The k best candidates that the ledger doesn't hold. Give the ranking a last key that breaks ties."""
    return candidates.join(ledger.select(key), key, "left_anti").orderBy(*ranking).limit(k)


def digest_ranking(in_city: str, confirmed: str, score: str, seq: str) -> list[Column]:
    return [F.desc(in_city), F.coalesce(F.col(confirmed), F.lit(False)).desc(), F.coalesce(score, F.lit(0)).desc(), F.desc(seq)]


def show_digest(digests: DataFrame, items: DataFrame, ids: str, item_key: str, label: str, missing: str) -> DataFrame:
    """One row for each id of each digest in order, items that are gone with a placeholder."""
    each = digests.select("digest_id", F.posexplode_outer(ids).alias("pos", item_key))
    return each.join(items.select(item_key, label), item_key, "left").select("digest_id", "pos", item_key, F.coalesce(label, F.lit(missing)).alias(label))


def digest_body(shown: DataFrame, label: str) -> DataFrame:
    """The message text of each digest: numbered lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", label))), lambda x: F.concat((x["pos"] + 1).cast("string"), F.lit(". "), x[label]))
    return shown.where("pos IS NOT NULL").groupBy("digest_id").agg(F.array_join(lines, "\n").alias("body"))
