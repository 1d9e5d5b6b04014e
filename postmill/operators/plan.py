"""Learning plans, tailored documents, block models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import NO_INFO, PRACTISED

MUST, HELPFUL, LATER = "面试前必须补", "有帮助但不必优先", "入职后可以继续补"


def hours(match: Column, optional: Column) -> Column:
    return F.when((match == PRACTISED) | optional, 1).when(match == NO_INFO, 2).otherwise(3)


def plan_items(dims: DataFrame, topic: str, match: Column, optional: Column, project: Column) -> DataFrame:
    """dims with item_id (the same for one topic and project), priority and hours."""
    helpful = (match == PRACTISED) | optional
    return dims.withColumns({"item_id": F.substring(F.sha2(F.concat(F.col(topic), F.coalesce(project, F.lit(""))), 256), 1, 16), "priority": F.when(helpful, HELPFUL).otherwise(MUST), "hours": hours(match, optional)})


def plan_total(items: DataFrame, by: str, weekly: float) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col("priority") == MUST, F.col("hours"))), F.lit(0))
    return items.groupBy(by).agg(total.cast("bigint").alias("interview_hours"), F.bround(total / F.lit(weekly), 1).alias("estimated_weeks"))


def best_project(projects: Column, tag: Column) -> Column:
    """The first project that has the tag, else the first one, else null."""
    return F.coalesce(F.try_element_at(F.filter(projects, lambda p: F.array_contains(p["tags"], tag)), F.lit(1)), F.try_element_at(projects, F.lit(1)))


def relevant_first(items: Column, is_relevant) -> Column:
    return F.concat(F.filter(items, is_relevant), F.filter(items, lambda x: ~is_relevant(x)))


def blocks(parts: list[tuple[str, Column]]) -> Column:
    """An ordered array of (kind, text), blank texts dropped. A part is one text or an array of texts."""

    def of(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))

    each = [F.transform(col, of(kind)) for kind, col in parts]
    return F.filter(F.concat(*each), lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != "")


def block_rows(df: DataFrame, key: str, col: Column) -> DataFrame:
    return df.select(key, F.posexplode(col).alias("pos", "block")).select(key, "pos", "block.kind", "block.text")
