"""Requirements against evidence: unknown stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import BELOW, MEETS
from ..functions.text import known, mentions_any, sentences

#: Results, and the nine facts of a posting.
PRACTISED, CLAIMED, LEARNED, NO_INFO = "有已确认实践证据", "自述实践，深度待核对", "仅学习过，缺实践证据", "信息不足"
SKIP, TRAIN, FIRST, TALK = "暂不优先", "补强后投递", "优先投递", "值得沟通"
FACTS = ["company", "title", "city", "salary_raw", "experience", "education", "responsibilities", "requirements", "published_at"]


def evidence_bank(skills: DataFrame, projects: DataFrame) -> DataFrame:
    """(ref, text, confirmed, level, tags, has_detail) of skills (pos, name, evidence, level, confirmed, tags) and projects (id, title, context, bullets, confirmed, tags)."""
    s = skills.select(F.concat(F.lit("skill:"), F.col("pos").cast("string")).alias("ref"), F.concat("name", F.lit("："), F.coalesce("evidence", F.lit(""))).alias("text"), "confirmed", F.coalesce("level", F.lit("unknown")).alias("level"), "tags", (F.trim(F.coalesce("evidence", F.lit(""))) != "").alias("has_detail"))
    p = projects.select(F.concat(F.lit("project:"), "id").alias("ref"), F.concat_ws("；", "title", "context", F.array_join("bullets", "；")).alias("text"), "confirmed", F.lit("done").alias("level"), "tags", (F.size("bullets") > 0).alias("has_detail"))
    return s.unionByName(p)


def dimensions(required: DataFrame, bank: DataFrame) -> DataFrame:
    """required (job, tag) with match, score and the refs of the evidence; every requirement stays."""
    e = bank.select("ref", "level", "confirmed", "has_detail", F.explode("tags").alias("tag"))
    j = required.join(e, "tag", "left")
    agg = j.groupBy("job", "tag").agg(
        F.coalesce(F.bool_or((F.col("level") == "done") & F.col("confirmed") & F.col("has_detail")), F.lit(False)).alias("practised"),
        F.coalesce(F.bool_or(F.col("level") == "done"), F.lit(False)).alias("done"),
        F.coalesce(F.bool_or(F.col("level") == "learned"), F.lit(False)).alias("learned"),
        F.array_sort(F.collect_list("ref")).alias("evidence"),
    )
    match = F.when(F.col("practised"), PRACTISED).when(F.col("done"), CLAIMED).when(F.col("learned"), LEARNED).otherwise(NO_INFO)
    return agg.select("job", "tag", match.alias("match"), score(match).alias("score"), "evidence")


def score(match: Column) -> Column:
    return F.when(match == PRACTISED, 100).when(match == LEARNED, 45)


def overall(dims: DataFrame, by: str = "job", score_col: str = "score") -> DataFrame:
    """Mean of the known scores rounded half to even (null if none), and whether all are known and 80 or more."""
    return dims.groupBy(by).agg(F.bround(F.avg(score_col)).cast("bigint").alias("score"), F.coalesce((F.min(score_col) >= 80) & (F.count(score_col) == F.count("*")), F.lit(False)).alias("all_strong"))


def completeness(cols: list[str] = FACTS) -> Column:
    """How many percent of the facts are known."""
    total = sum((known(F.col(c)).cast("int") for c in cols[1:]), known(F.col(cols[0])).cast("int"))
    return F.bround(total * 100.0 / len(cols)).cast("bigint")


def recommendation(pay: Column, closed: Column, learned_only: Column, has_project: Column, all_strong: Column, in_city: Column) -> Column:
    return F.when((pay == BELOW) | closed, SKIP).when(learned_only & ~has_project, TRAIN).when(all_strong & (pay == MEETS) & in_city, FIRST).otherwise(TALK)


def role_sentences(text: Column, roles: dict[str, list[str]]) -> Column:
    """For each role that a sentence mentions: (role, first such sentence), in the roles' order."""

    def test(terms: list[str]):
        return lambda s: mentions_any(s, terms)

    each = [F.try_element_at(F.filter(sentences(text), test(terms)), F.lit(1)) for terms in roles.values()]
    return F.filter(F.array(*[F.struct(F.lit(role).alias("role"), quote.alias("quote")) for role, quote in zip(roles, each, strict=True)]), lambda x: x["quote"].isNotNull())


def relevant(title: Column, found: Column, wanted: list[str], words: list[str], common: list[str]) -> Column:
    """The title has a role word, and text and profile share a tag that isn't a common one."""
    shared = F.array_except(F.array_intersect(found, F.array(*map(F.lit, wanted))), F.array(*map(F.lit, common)))
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(f"\\Q{w}\\E" for w in words)) & (F.size(shared) > 0)


def by_overlap(items: Column, wanted: Column, tags_of) -> Column:
    """An array ordered by how many wanted tags each item has, most first; equal ones keep their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-F.size(F.array_intersect(tags_of(x), wanted))).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def supported(quote: Column, source: Column, refs: Column, bank: Column) -> Column:
    """A claim holds if its quote is in the source and all its refs are confirmed entries of the bank (map ref -> confirmed)."""
    return (quote != "") & source.contains(quote) & F.forall(refs, lambda r: F.coalesce(F.try_element_at(bank, r), F.lit(False)))


def same_numbers(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))
