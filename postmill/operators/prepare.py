"""Preparation for one posting: tailored documents, questions, cases. Facts are only reordered, never made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import by_overlap
from .plan import relevant_first

#: (audience, priority, template, purpose) of questions (fixed values); {salary}, {city}, {duties}, {topics} and {target} are filled in.
QUESTIONS = [
    ("HR", 1, "岗位标注“{salary}”，固定税前月薪的范围是多少？额外薪数、奖金与股权是否另计？", "确认固定月薪是否达到{target}元，避免年包口径误差"),
    ("HR", 2, "工作地点标注为“{city}”，出差、驻场和到岗安排分别是什么？", "确认地点及交付安排是否可接受"),
    ("用人经理", 1, "针对“{duties}”，入职前三个月最主要的交付和验收标准是什么？", "明确研发、训练、部署与客户交付的实际时间分配"),
    ("用人经理", 2, "目前有哪些可用数据、标注资源、算力与部署环境？算法选型和试验优先级由谁决定？", "确认资源条件和自主决策范围；不依据公司标签推断"),
    ("用人经理", 3, "日常技术评审和跨团队沟通使用哪些语言？能否举一次工程师自主推动方案的例子？", "核实英文交流比例、团队层级和技术自主性"),
    ("技术面试官", 1, "岗位涉及{topics}时，最难的失败样本和当前基线是什么？如何做离线与线上验证？", "将已做项目中的数据划分、误差分析和部署取舍与岗位对齐"),
]


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), value)
    return template


def question_array(topics: Column, target: int = 40_000) -> Column:
    """The six questions on a posting (audience, priority, question, purpose); what is unknown is told so."""
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    values = {
        "salary": named("salary_raw", "未披露"),
        "city": named("city", "未知"),
        "duties": F.substring(named("responsibilities", "尚未披露职责"), 1, 180),
        "topics": F.coalesce(F.nullif(F.array_join(F.slice(topics, 1, 3), ", "), F.lit("")), F.lit("相关算法")),
        "target": F.lit(f"{target:,}"),
    }
    return F.array(*[F.struct(F.lit(a).alias("audience"), F.lit(p).alias("priority"), _filled(F.lit(t), values).alias("question"), _filled(F.lit(w), values).alias("purpose")) for a, p, t, w in QUESTIONS])


def questions(postings: DataFrame, id_col: str, topics: Column, target: int = 40_000) -> DataFrame:
    """Six rows a posting (id, audience, priority, question, purpose)."""
    return postings.select(id_col, F.explode(question_array(topics, target)).alias("q")).select(id_col, "q.*")


def tailored(profiles: DataFrame, wanted: Column, tags_of) -> DataFrame:
    """profiles (ready, projects[{id, title, bullets, confirmed}], skills[{name, level, confirmed}]) with their order for a posting.

    Confirmed projects with facts stand by how many wanted tags they show, their facts too, confirmed done
    skills relevant ones first; `changes` tells the old and the new order. Profiles that aren't ready, or
    have no such project, are left out: nothing is invented for them."""
    projects = F.filter("projects", lambda p: p["confirmed"] & (F.coalesce(p["title"], F.lit("")) != "") & (F.size(p["bullets"]) > 0))
    text_of = lambda p: F.concat_ws(" ", p["title"], F.array_join(p["bullets"], " "))
    ordered = F.transform(by_overlap(projects, wanted, lambda p: tags_of(text_of(p))), lambda p: F.struct(p["id"].alias("id"), p["title"].alias("title"), by_overlap(p["bullets"], wanted, tags_of).alias("bullets")))
    skills = F.transform(F.filter("skills", lambda s: s["confirmed"] & (s["level"] == "done")), lambda s: s["name"])
    arrow = lambda names: F.array_join(names, " → ")
    out = profiles.withColumns({"_p": projects, "_s": skills}).where(F.col("ready") & (F.size("_p") > 0))
    out = out.withColumns({"ordered_projects": ordered, "ordered_skills": relevant_first(F.col("_s"), lambda s: F.arrays_overlap(tags_of(s), wanted))})
    change = lambda before, after: F.struct(before.alias("before"), after.alias("after"))
    changes = F.array(change(arrow(F.transform("_p", lambda p: p["title"])), arrow(F.transform("ordered_projects", lambda p: p["title"]))), change(arrow(F.col("_s")), arrow(F.col("ordered_skills"))))
    return out.withColumn("changes", changes).drop("_p", "_s")


def cases(tailored_: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """The first k projects of a tailored profile as cases: (id, pos, ref, title, facts)."""
    return tailored_.select(id_col, F.posexplode(F.slice("ordered_projects", 1, k)).alias("pos", "p")).select(id_col, "pos", F.concat(F.lit("project:"), "p.id").alias("ref"), "p.title", F.col("p.bullets").alias("facts"))
