"""Postings matched with a profile's evidence, reports on them, and listings decorated with both.

The evidence is grouped by tag first, so that the side that is joined to the requirements of all postings has one row
a tag. Requirements are exploded, joined, and put together again, in order, by posting; everything else is an
expression on the posting's own row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import least_years
from ..functions.money import with_salary
from ..functions.text import bound, lines, nfkc, sentences, tags
from .matching import CLAIMED, FACTS, LEARNED, NO_INFO, PRACTISED, completeness, recommendation, role_sentences, score
from .prepare import question_array

#: Priorities of a requirement and the lines that begin them, what each result means, places, notes.
BONUS, WANTED = "加分项", "要求（重要程度待确认）"
BONUS_LINE, WANTED_LINE = r"(?iu)bonus|preferred|nice.to.have|加分项|优先条件|优先考虑", r"(?iuU)^\s*(?:requirements|must.have|minimum qualifications|任职要求|必备条件)"
GAPS = {PRACTISED: "词汇对应已有实践；复杂度、规模与个人贡献仍需核对", CLAIMED: "初始自述不等于已核验的项目证据", LEARNED: "将学习经历与已完成工作分开", NO_INFO: "画像中未找到证据，不据此判定不具备能力"}
IN_CITY, NO_CITY, OTHER_CITY = "优先城市", "地点待确认", "其他城市/远程，单独考虑"
ENOUGH, TOO_FEW, LEVEL_OPEN = "自述年限达到已识别的最低年限，职级仍待确认", "已知年限可能不足，需确认可替代的项目深度", "待确认职责范围与级别"
TRAVEL, NO_TRAVEL = ["出差", "驻场", "travel", "onsite"], "未披露，需确认"
ROLES = {"研究": ["论文", "研究", "research", "publication"], "算法研发": ["算法", "algorithm", "model development"], "训练工程": ["训练", "training"], "部署": ["部署", "deployment", "inference"], "数据闭环": ["数据闭环", "data curation", "数据采集", "标注"], "客户交付": ["客户", "交付", "驻场", "customer", "delivery"]}
FACT = "明确事实"
CLAIM_ERRORS = ["quote not in the posting", "unknown evidence", "a fact without source", "a fact on unconfirmed evidence"]


@dataclass(frozen=True)
class Profile:
    """What of a profile isn't a table."""

    target: int = 40_000
    years: float = 0
    city: str = "深圳"
    directions: list[str] = field(default_factory=list)
    confirmed: bool = False
    summary: str = ""
    experience: list[str] = field(default_factory=list)


def priorities(text_lines: Column, quotes: Column, bonus: str = BONUS_LINE, wanted: str = WANTED_LINE) -> Column:
    """For each quote the priority that holds at the first line that contains it.

    A line of the pattern `bonus` begins the bonus part, else one of `wanted` ends it, that line included. A quote that no
    line holds, or an empty one, is simply wanted."""
    marked = F.transform(text_lines, lambda line: F.struct(line.alias("line"), F.when(line.rlike(bonus), F.lit(True)).when(line.rlike(wanted), F.lit(False)).alias("mark")))

    def each(told: Column) -> Column:
        def of(quote: Column) -> Column:
            at = F.array_position(F.transform(told, lambda x: x["line"].contains(quote)), F.lit(True)).cast("int")
            until = F.filter(F.slice(told, 1, at), lambda x: x["mark"].isNotNull())
            return F.when((quote != "") & F.coalesce(F.try_element_at(until, F.lit(-1))["mark"], F.lit(False)), BONUS).otherwise(WANTED)

        return F.transform(quotes, of)

    return bound(marked, each)


def requirements(postings: DataFrame, vocabulary: dict[str, list[str]], key: str = "job", bonus: str = BONUS_LINE, wanted: str = WANTED_LINE) -> DataFrame:
    """postings (key, title, responsibilities, requirements) with their `required` tags, and `asked`, an array of (requirement, job_quote, priority)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    jd = postings.withColumn("_jd", F.concat_ws("\n", empty("title"), empty("responsibilities"), empty("requirements")))
    said = F.transform(sentences(F.col("_jd")), lambda s: F.struct(s.alias("s"), tags(s, vocabulary).alias("tags")))
    jd = jd.withColumns({"required": tags(F.col("_jd"), vocabulary), "_said": said, "_lines": lines(F.col("_jd"))})

    def quotes(said: Column) -> Column:
        return F.transform("required", lambda tag: F.coalesce(F.try_element_at(F.filter(said, lambda x: F.array_contains(x["tags"], tag)), F.lit(1))["s"], F.lit("")))

    jd = jd.withColumn("_quotes", bound(F.col("_said"), quotes)).withColumn("_priorities", priorities(F.col("_lines"), F.col("_quotes"), bonus, wanted))
    asked = F.zip_with(F.arrays_zip(F.col("required").alias("requirement"), F.col("_quotes").alias("job_quote")), "_priorities", lambda a, p: F.struct(a["requirement"].alias("requirement"), a["job_quote"].alias("job_quote"), p.alias("priority")))
    return jd.withColumn("asked", asked).drop("_said", "_lines", "_quotes", "_priorities")


def bank(skills: DataFrame, projects: DataFrame, vocabulary: dict[str, list[str]], profile: Profile = Profile()) -> DataFrame:
    """(place, ref, text, confirmed, level, tags, has_detail) of skills (pos, name, evidence, level, confirmed), then projects (pos, id, title, context, bullets, skills, confirmed), then a confirmed profile."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), pos.cast("bigint").alias("pos")).alias("place")
    sure = F.coalesce("confirmed", F.lit(False)).alias("confirmed")
    s = skills.select(place(0, F.col("pos")), F.concat(F.lit("skill:"), F.col("pos").cast("string")).alias("ref"), F.concat(empty("name"), F.lit("："), empty("evidence")).alias("text"), sure, F.coalesce("level", F.lit("unknown")).alias("level"), tags(F.col("name"), vocabulary).alias("tags"), (F.regexp_replace(empty("evidence"), r"(?U)\s+", "") != "").alias("has_detail"))
    facts = F.coalesce("bullets", F.array().cast("array<string>"))
    p = projects.select(place(1, F.col("pos")), F.concat(F.lit("project:"), F.col("id").cast("string")).alias("ref"), F.concat(empty("title"), F.lit("；"), empty("context"), F.lit("；"), F.array_join(facts, "；")).alias("text"), sure, F.lit("done").alias("level"), tags(F.array_join("skills", " "), vocabulary).alias("tags"), (F.size(facts) > 0).alias("has_detail"))
    out = s.unionByName(p)
    if profile.confirmed:
        rows = [(0, "profile:summary", profile.summary), (1, "profile:experience", "；".join(profile.experience))]
        own = skills.sparkSession.createDataFrame(rows, "pos int, ref string, text string")
        out = out.unionByName(own.select(place(2, F.col("pos")), "ref", "text", F.lit(True).alias("confirmed"), F.lit("background").alias("level"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("has_detail")))
    return out


def evidence_by_tag(evidence: DataFrame) -> DataFrame:
    """(tag, match, evidence) of a bank: one row a tag, its entries in the bank's order."""
    e = evidence.select(F.explode("tags").alias("tag"), F.struct("place", "ref", "text", "confirmed", "level", "has_detail").alias("e"))
    done = F.col("e.level") == "done"
    each = e.groupBy("tag").agg(F.bool_or(done & F.col("e.confirmed") & F.col("e.has_detail")).alias("practised"), F.bool_or(done).alias("done"), F.bool_or(F.col("e.level") == "learned").alias("learned"), F.array_sort(F.collect_list("e")).alias("e"))
    match = F.when(F.col("practised"), PRACTISED).when(F.col("done"), CLAIMED).when(F.col("learned"), LEARNED).otherwise(NO_INFO)
    return each.select("tag", match.alias("match"), F.transform("e", lambda x: F.struct(x["ref"].alias("ref"), x["text"].alias("text"), x["confirmed"].alias("confirmed"), x["level"].alias("level"), x["has_detail"].alias("has_detail"))).alias("evidence"))


def dimension_rows(asked: DataFrame, evidence: DataFrame, key: str = "job") -> DataFrame:
    """A row for each requirement of `asked` (key, asked): pos, requirement, job_quote, priority, match, score, gap, evidence."""
    rows = asked.select(key, F.posexplode("asked").alias("pos", "a")).select(key, "pos", "a.*")
    known = evidence_by_tag(evidence).withColumnRenamed("tag", "requirement")
    match = F.coalesce("match", F.lit(NO_INFO))
    gap = F.element_at(F.create_map(*[F.lit(x) for pair in GAPS.items() for x in pair]), match)
    none = F.expr("cast(array() as array<struct<ref:string,text:string,confirmed:boolean,level:string,has_detail:boolean>>)")
    return rows.join(known, "requirement", "left").select(key, "pos", "requirement", "job_quote", "priority", match.alias("match"), score(match).alias("score"), gap.alias("gap"), F.coalesce("evidence", none).alias("evidence"))


def confirmed_projects(projects: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(pos, ref, title, p_tags) of the confirmed projects, with the tags of all that they tell."""
    told = F.concat_ws(" ", F.col("id").cast("string"), "title", "context", F.array_join("bullets", " "), F.array_join("skills", " "))
    return projects.where("confirmed").select(F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("project:"), F.col("id").cast("string")).alias("ref"), "title", tags(told, vocabulary).alias("p_tags"))


def top_projects(asked: DataFrame, own: DataFrame, key: str = "job", k: int = 3) -> DataFrame:
    """(key, found): the projects that share most required tags, most first, equal ones in their order; at most k that share any."""
    wanted = asked.select(key, F.explode("required").alias("tag"))
    shared = wanted.join(own.select("pos", "ref", "title", F.explode("p_tags").alias("tag")), "tag").groupBy(key, "pos", "ref", "title").agg(F.count("*").alias("n"))
    return shared.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "pos", "ref", "title"))), 1, k), lambda x: F.struct(x["ref"].alias("ref"), x["title"].alias("title"))).alias("found"))


def match(postings: DataFrame, skills: DataFrame, projects: DataFrame, vocabulary: dict[str, list[str]], profile: Profile = Profile(), key: str = "job", roles: dict[str, list[str]] = ROLES, bonus: str = BONUS_LINE, wanted: str = WANTED_LINE) -> DataFrame:
    """One row a posting: what it asks for, the evidence for that, and what follows.

    postings: key (unique), the nine facts, status_validity. An unknown score is null and doesn't count; a posting that asks for
    nothing known has no dimensions. Columns: nature, dimensions, project_match, level, direction, constraints, recommendation, score,
    n_known, all_strong, information_completeness, unconfirmed, attention, missing_profile."""
    evidence = bank(skills, projects, vocabulary, profile)
    own = confirmed_projects(projects, vocabulary)
    asked = requirements(postings, vocabulary, key, bonus, wanted)
    dims = dimension_rows(asked.select(key, "asked"), evidence, key)
    one = F.struct("pos", "requirement", "job_quote", "priority", "match", "score", "gap", "evidence")
    by_job = dims.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("dims"), F.bround(F.avg("score")).cast("bigint").alias("score"), F.count("score").alias("n_known"), ((F.min("score") >= 80) & (F.count("score") == F.count("*"))).alias("all_strong"), F.bool_or(F.col("match") == LEARNED).alias("learned_only"))
    none_own = F.expr("cast(array() as array<struct<pos:bigint,ref:string,title:string,p_tags:array<string>>>)")
    first = own.agg(F.coalesce(F.array_sort(F.collect_list(F.struct("pos", "ref", "title", "p_tags"))), none_own).alias("own"))  # a person's projects, one row
    paid = with_salary(asked, "salary_raw", "salary", target=profile.target, narrowed=nfkc(F.col("salary_raw")))
    rows = paid.join(by_job, key, "left").join(top_projects(asked.select(key, "required"), own, key), key, "left").join(F.broadcast(first))
    refs = lambda arr: F.transform(arr, lambda x: x["ref"])
    found = F.coalesce("found", F.expr("cast(array() as array<struct<ref:string,title:string>>)"))
    rest = F.filter("own", lambda p: ~F.array_contains(refs(F.col("_found")), p["ref"]))
    rows = rows.withColumn("_found", found).withColumn("_rest", F.transform(rest, lambda p: F.struct(p["ref"].alias("ref"), p["title"].alias("title"))))
    shared = lambda ref: F.array_intersect("required", F.try_element_at(F.filter("own", lambda p: p["ref"] == ref), F.lit(1))["p_tags"])
    chosen = F.transform(F.slice(F.concat("_found", "_rest"), 1, 3), lambda p: F.struct(p["ref"].alias("ref"), p["title"].alias("title"), shared(p["ref"]).alias("shared_skills")))
    has_project, city, pay = F.size("own") > 0, F.coalesce("city", F.lit("")), F.col("salary.group")
    in_city = F.lit(profile.city != "") & city.contains(profile.city)
    where = F.when(in_city, IN_CITY).when(city == "", NO_CITY).otherwise(OTHER_CITY)
    years = least_years(F.coalesce("experience", F.lit("")))
    level = F.struct(F.coalesce(F.nullif(F.col("experience"), F.lit("")), F.lit("未知")).alias("requirement"), F.lit(f"自述约{profile.years:g}年经验").alias("evidence"), F.when(years.isNull(), LEVEL_OPEN).when(F.lit(float(profile.years)) >= years, ENOUGH).otherwise(TOO_FEW).alias("match"))
    duties = F.when(F.coalesce("responsibilities", F.lit("")) != "", F.col("responsibilities")).otherwise(F.col("_jd"))
    named = lambda terms: lambda s: F.exists(F.array(*map(F.lit, terms)), lambda t: s.contains(t))
    travel = F.coalesce(F.try_element_at(F.filter(sentences(F.col("_jd")), named(TRAVEL)), F.lit(1)), F.lit(NO_TRAVEL))
    constraints = F.struct(F.col("salary"), F.coalesce(F.nullif(F.col("salary_raw"), F.lit("")), F.lit("未知")).alias("salary_raw"), F.struct(F.coalesce(F.nullif(city, F.lit("")), F.lit("未知")).alias("job"), F.lit(profile.city).alias("preferred"), where.alias("result")).alias("location"), travel.alias("travel"))
    no_dims = F.array().cast(dict(by_job.dtypes)["dims"])
    say = lambda test, words: F.when(test, F.array(F.lit(words))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        key, "required", role_sentences(duties, roles).alias("nature"), F.coalesce("dims", no_dims).alias("dimensions"), chosen.alias("project_match"), level.alias("level"),
        F.struct(F.array(*map(F.lit, profile.directions)).cast("array<string>").alias("desired"), F.col("required").alias("job_tags")).alias("direction"), constraints.alias("constraints"),
        recommendation(pay, F.coalesce(F.col("status_validity") == "已关闭", F.lit(False)), F.coalesce("learned_only", F.lit(False)), has_project, F.coalesce("all_strong", F.lit(False)), in_city).alias("recommendation"),
        "score", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("all_strong", F.lit(False)).alias("all_strong"), completeness().alias("information_completeness"),
        say(F.coalesce("published_at", F.lit("")) == "", "岗位发布时间未知").alias("unconfirmed"), question_array(F.col("required"), profile.target).alias("attention"), say(~has_project, "补充并确认具体项目、个人贡献、验证方式和指标").alias("missing_profile"),
    )


def checked_claims(claims: DataFrame, postings: DataFrame, evidence: DataFrame, key: str = "job") -> DataFrame:
    """claims (key, pos, kind, job_quote, evidence_refs) with `error`, null for those that hold.

    A quote has to be in the posting (title, raw_text, responsibilities, requirements, pay, city), a ref in the bank, and a fact needs a
    source, all of it confirmed. A claim on a posting that isn't there quotes in vain."""
    refs = claims.select(key, "pos", F.explode("evidence_refs").alias("ref")).join(evidence.select("ref", "confirmed"), "ref", "left")
    refs = refs.groupBy(key, "pos").agg(F.bool_or(F.col("confirmed").isNull()).alias("unknown"), F.bool_or(~F.col("confirmed")).alias("open"))
    told = postings.select(key, F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "raw_text", "responsibilities", "requirements", "salary_raw", "city")]).alias("raw"))
    joined = claims.join(refs, [key, "pos"], "left").join(told, key, "left")
    quote, fact = F.coalesce("job_quote", F.lit("")), F.col("kind") == FACT
    error = (
        F.when((quote != "") & ~F.coalesce(F.col("raw").contains(quote), F.lit(False)), CLAIM_ERRORS[0])
        .when(F.coalesce("unknown", F.lit(False)), CLAIM_ERRORS[1])
        .when(fact & (quote == "") & (F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0), CLAIM_ERRORS[2])
        .when(fact & F.coalesce("open", F.lit(False)), CLAIM_ERRORS[3])
    )
    return joined.select(*[claims[c] if c != key else F.col(key) for c in claims.columns], error.alias("error"))


def report(matched: DataFrame, checked: DataFrame | None = None, key: str = "job") -> DataFrame:
    """matched with strengths (dimensions with evidence), gaps (those not practised), emphasis, and, where all claims on a posting
    hold, the claims in order; else `claims` is null and `rejected` names the first claim's fault."""
    out = matched.withColumns({"strengths": F.filter("dimensions", lambda d: F.size(d["evidence"]) > 0), "gaps": F.filter("dimensions", lambda d: d["match"] != PRACTISED), "emphasis": F.col("project_match")})
    if checked is None:
        return out
    whole = F.array_sort(F.collect_list(F.struct("pos", "kind", "job_quote", "evidence_refs")))
    by_job = checked.groupBy(key).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("rejected"), whole.alias("_claims"))
    return out.join(by_job, key, "left").withColumn("claims", F.when(F.col("rejected").isNull(), F.col("_claims"))).drop("_claims")


def decorated(postings: DataFrame, stored: DataFrame, analyse, profile: Profile = Profile(), key: str = "job") -> DataFrame:
    """postings with pay, recommendation, match_score, themes, place and the reason in words.

    stored (key, recommendation, score, themes, place): analyses made before; only postings without one are given to
    analyse(postings) -> match's columns."""
    missing = postings.join(stored.select(key), key, "left_anti")
    made = analyse(missing).select(key, "recommendation", "score", F.col("direction.job_tags").alias("themes"), F.col("constraints.location.result").alias("place"))
    told = stored.select(key, "recommendation", "score", "themes", "place").unionByName(made)
    paid = with_salary(postings, "salary_raw", "salary_detail", target=profile.target, narrowed=nfkc(F.col("salary_raw"))).withColumn("salary_group", F.col("salary_detail.group"))
    themes = F.coalesce(F.nullif(F.array_join(F.slice("themes", 1, 4), ", "), F.lit("")), F.lit("职责尚待补充"))
    reason = F.concat(F.lit("岗位主题："), themes, F.lit("。"), F.col("place"), F.lit("；"), F.col("salary_group"), F.lit("。"), F.col("recommendation"), F.lit("，具体深度按经历证据核对。"))
    return paid.join(told, key).withColumn("reason", reason).withColumnRenamed("score", "match_score")


def learning_plan(matched: DataFrame, projects: DataFrame, vocabulary: dict[str, list[str]], key: str = "job") -> DataFrame:
    """A row for each dimension of a matched posting: what to prepare, with which project, and the hours; its priority decides, not the caller."""
    from .plan import best_project, plan_items

    own = confirmed_projects(projects, vocabulary).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref", "p_tags"))), lambda p: F.struct(p["ref"].alias("ref"), p["p_tags"].alias("tags"))).alias("own"))
    rows = matched.select(key, F.explode("dimensions").alias("d")).select(key, "d.*").join(F.broadcast(own))
    rows = rows.withColumn("project", F.substring(best_project(F.col("own"), F.col("requirement"))["ref"], len("project:") + 1, 1 << 30))
    return plan_items(rows.drop("own", "score", "evidence", "gap"), "requirement", F.col("match"), F.col("priority") == BONUS, F.col("project"))
