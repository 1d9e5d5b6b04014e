"""Reports on postings: priorities, unknown scores, projects, claims."""

from pyspark.sql import functions as F

from postmill.functions.text import lines
from postmill.operators import matching, report
from postmill.operators.matching import FACTS

VOCABULARY = {"检测": ["检测", "yolo"], "MIL": ["mil"], "部署": ["部署", "deployment"], "C++": ["c++"]}
SKILLS = "pos int, name string, evidence string, level string, confirmed boolean"
PROJECTS = "pos int, id string, title string, context string, bullets array<string>, skills array<string>, confirmed boolean"


def postings(spark, *rows):
    names = ["job", *FACTS, "status_validity", "raw_text"]
    return spark.createDataFrame([tuple({**dict.fromkeys(names), **r}[n] for n in names) for r in rows], "job bigint, " + ", ".join(f"{n} string" for n in names[1:]))


def tables(spark, skills=(), projects=()):
    return spark.createDataFrame(list(skills), SKILLS), spark.createDataFrame(list(projects), PROJECTS)


def test_priority_is_that_of_the_first_line_with_the_quote(spark):
    text = "Requirements:\nPython\nBonus Qualifications:\nMIL\nmust have\nC++\nMIL again"
    df = spark.createDataFrame([(text,), (None,)], "t string").withColumn("q", F.array(*map(F.lit, ["Python", "MIL", "C++", "none", "", "Bonus Q"])))
    got = [r.p for r in df.select(report.priorities(lines(F.col("t")), F.col("q")).alias("p")).collect()]
    b, w = report.BONUS, report.WANTED
    assert got[0] == [w, b, w, w, w, b] and got[1] == [w] * 6


def test_match_tells_what_is_known_and_nothing_else(spark):
    skills, projects = tables(spark, [(0, "YOLO 检测", "built", "done", True), (1, "MIL", "", "learned", True), (2, "部署", " ", "done", True)], [(0, "p0", "plain", "", ["x"], ["none"], True), (1, "p1", "检测 and C++", "", ["b"], ["deployment"], True), (2, "p2", "C++", None, None, ["c++"], False)])
    jobs = postings(spark, {"job": 1, "title": "检测", "requirements": "检测；MIL\n加分项\n部署", "salary_raw": "月薪45-60K", "city": "深圳南山", "experience": "3-5年", "responsibilities": "出差 to customer"}, {"job": 2, "responsibilities": "yolo", "salary_raw": "月薪45-60K", "city": "深圳"}, {"job": 3}, {"job": 4, "title": "C++", "salary_raw": "10-20K", "city": "x"})
    got = {r.job: r for r in report.report(report.match(jobs, skills, projects, VOCABULARY, report.Profile(years=4, confirmed=True))).collect()}
    a = got[1]
    assert [(d.requirement, d.match, d.score, d.priority, [e.ref for e in d.evidence]) for d in a.dimensions] == [
        ("检测", matching.PRACTISED, 100, report.WANTED, ["skill:0"]), ("MIL", matching.LEARNED, 45, report.WANTED, ["skill:1"]), ("部署", matching.PRACTISED, 100, report.BONUS, ["skill:2", "project:p1"])
    ]
    assert a.score == 82 and a.n_known == 3 and a.recommendation == matching.TALK and a.level.match == report.ENOUGH and a.constraints.travel == "出差 to customer"
    assert [(p.ref, p.shared_skills) for p in a.project_match] == [("project:p1", ["检测", "部署"]), ("project:p0", [])] and [g.requirement for g in a.gaps] == ["MIL"] and len(a.strengths) == 3 and len(a.attention) == 6
    assert got[2].recommendation == matching.FIRST and got[2].score == 100
    assert got[3].dimensions == [] and got[3].score is None and got[3].recommendation == matching.TALK and got[3].constraints.location.result == report.NO_CITY and got[3].unconfirmed
    assert got[4].recommendation == matching.SKIP and [d.match for d in got[4].dimensions] == [matching.CLAIMED]


def test_learned_only_without_project_is_trained_first(spark):
    skills, none = tables(spark, [(0, "MIL", "", "learned", True)])
    got = report.match(postings(spark, {"job": 1, "title": "MIL"}), skills, none, VOCABULARY).first()
    assert got.recommendation == matching.TRAIN and got.project_match == [] and got.missing_profile
    assert report.match(postings(spark), skills, none, VOCABULARY).count() == 0


def test_claims_need_their_sources(spark):
    skills, projects = tables(spark, [(0, "MIL", "x", "done", False)], [(0, "a", "t", "", ["x"], ["mil"], True)])
    jobs = postings(spark, {"job": 1, "title": "MIL", "raw_text": "the text"}, {"job": 2, "title": "other"}, {"job": 3})
    rows = [(1, 0, report.FACT, "the text", []), (1, 1, report.FACT, "", ["project:a"]), (2, 0, "x", "", []), (2, 1, report.FACT, "", ["skill:0"]), (2, 2, "x", "gone", []), (3, 0, report.FACT, None, None), (9, 0, "x", "q", ["none"])]
    claims = spark.createDataFrame(rows, "job bigint, pos int, kind string, job_quote string, evidence_refs array<string>")
    checked = report.checked_claims(claims, jobs, report.bank(skills, projects, VOCABULARY))
    assert {(r.job, r.pos): r.error for r in checked.collect()} == {(1, 0): None, (1, 1): None, (2, 0): None, (2, 1): report.CLAIM_ERRORS[3], (2, 2): report.CLAIM_ERRORS[0], (3, 0): report.CLAIM_ERRORS[2], (9, 0): report.CLAIM_ERRORS[0]}
    out = {r.job: r for r in report.report(report.match(jobs, skills, projects, VOCABULARY), checked).collect()}
    assert len(out[1].claims) == 2 and out[2].claims is None and out[2].rejected == report.CLAIM_ERRORS[3]
