"""Imports of several parts: pasted text, files and links, under budgets; a part that fails is told, and fails nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, host
from .listing import LIMITS
from .matching import FACTS
from .parsing import parse_postings
from .windows import merge_lines

#: Characters of the merged text that are parsed, and that are kept (fixed values).
PARSED, KEPT = 150_000, 300_000
IMAGES = ["png", "jpg", "jpeg", "webp"]


def budgets(parts: DataFrame, key: str = "import", limits: dict[str, int] = LIMITS) -> DataFrame:
    """(key, over, at): the first budget that an import's parts break, and at which of its parts; only imports that break one.

    parts: key, pos, kind (text, file or link), name, size (bytes), text. Text and links are counted whole, files one by one as they come: their number, the
    images among them, and the running sum of their sizes."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda kind: F.col("kind") == kind
    image = is_("file") & F.lower(F.element_at(F.split(F.coalesce("name", F.lit("")), r"\."), -1)).isin(IMAGES)
    so_far = {"files": F.count_if(is_("file")).over(w), "images": F.count_if(image).over(w), "links": F.count_if(is_("link")).over(w), "bytes": F.sum(F.when(is_("file"), F.col("size")).otherwise(0)).over(w)}
    length = F.sum(F.when(is_("text"), F.length("text")).otherwise(0)).over(w)
    links = F.sum(F.when(is_("link"), F.length("text") + 1).otherwise(0)).over(w)
    run = parts.withColumns({f"_{k}": v for k, v in (so_far | {"text": length, "urls": links}).items()})
    # budgets of the whole input come first, those of a part as soon as the part that breaks them
    over = [("text", 0), ("urls", 0), ("files", 1), ("images", 2), ("links", 3), ("bytes", 4)]
    found = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"_{k}") > limits[k], F.struct(F.lit(rank).alias("rank"), F.lit(k).alias("over"), F.col("pos").alias("at"))) for k, rank in over])))
    return run.groupBy(key).agg(F.min(found).alias("x")).where("x IS NOT NULL").select(key, "x.over", "x.at")


def import_parts(parts: DataFrame, key: str = "import", limits: dict[str, int] = LIMITS) -> DataFrame:
    """One row an import: over (the broken budget, null if none), raw_text, warnings, sources, attachments, originals, facts, uncertain_fields.

    parts: key, pos, kind, name, size, text (what a link or file gave; for a link also `name`, the link itself), error (why it gave nothing).
    An import that breaks a budget, or has no text, file or link, keeps its row without any content. Texts are merged in order, each line once. All that was read is told as uncertain."""
    over = budgets(parts, key, limits)
    link = F.when(F.col("kind") == "link", canonical_url(F.col("name")))
    good = parts.withColumns({"_url": link, "_text": F.when(F.col("error").isNull() & ((F.col("kind") != "link") | (link != "")), F.col("text"))})
    warning = F.when((F.col("kind") == "link") & (F.col("_url") == ""), F.concat(F.lit("not a link: "), F.coalesce("name", F.lit("")))).when(F.col("error").isNotNull(), F.concat(F.coalesce("name", F.lit("")), F.lit(": "), F.substring("error", 1, 250)))
    rows = lambda test, *cols: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", *cols)))), lambda x: x)
    by = good.withColumn("_warning", warning).groupBy(key).agg(
        F.array_join(F.transform(rows(F.col("_text").isNotNull(), "_text"), lambda x: x["_text"]), "\n").alias("_all"),
        F.transform(rows(F.col("_warning").isNotNull(), "_warning"), lambda x: x["_warning"]).alias("warnings"),
        F.transform(rows((F.col("kind") == "link") & (F.col("_url") != ""), "_url", "error"), lambda x: F.struct(x["_url"].alias("url"), host(x["_url"]).alias("name"), x["error"].isNull().alias("fetched"))).alias("sources"),
        F.transform(rows(F.col("kind") == "file", "name"), lambda x: x["name"]).alias("attachments"),
        F.transform(rows(F.col("_text").isNotNull(), "kind", "name", "_text"), lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["_text"].alias("text"))).alias("originals"),
        F.bool_or((F.col("kind") != "text") | (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("_any"),
    )
    by = by.join(over.select(key, "over"), key, "left").withColumn("over", F.coalesce("over", F.when(~F.coalesce("_any", F.lit(False)), F.lit("nothing"))))
    merged = merge_lines(by.where("over IS NULL"), key, ["_all"], "_merged")
    long = F.length("_merged") > PARSED
    facts = parse_postings(merged.select(key, F.substring("_merged", 1, PARSED).alias("_parsed")), key, "_parsed")
    told = merged.join(facts, key).withColumns({"raw_text": F.substring("_merged", 1, KEPT), "_long": long, "uncertain_fields": F.array_union("uncertain_fields", F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) != "", F.lit(f)) for f in FACTS])))}).drop("_merged")
    none = lambda c: F.when(F.col("over").isNull(), F.col(c)).alias(c)
    cut = F.when(F.col("_long"), F.array(F.lit(f"only the first {PARSED} characters were parsed"))).otherwise(F.array().cast("array<string>"))
    out = by.join(told, key, "left")
    return out.select(key, "over", "raw_text", F.when(F.col("over").isNull(), F.concat("warnings", cut)).alias("warnings"), none("sources"), none("attachments"), none("originals"), *FACTS, F.array_sort("uncertain_fields").alias("uncertain_fields"))
