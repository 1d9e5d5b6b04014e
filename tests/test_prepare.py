from pyspark.sql import functions as F

from postmill.functions.text import tags
from postmill.operators import prepare

WORDS = {"det": ["detection"], "py": ["python"], "edge": ["edge"]}


def test_questions_tell_unknown(spark):
    df = spark.createDataFrame([(1, "40K", "", None, ["a", "b", "c", "d"]), (2, None, "SZ", "x" * 300, [])], "id int, salary_raw string, city string, responsibilities string, t array<string>")
    got = {(r.id, r.audience, r.priority): r for r in prepare.questions(df, "id", F.col("t")).collect()}
    assert len(got) == 12
    assert "“40K”" in got[1, "HR", 1].question and "40,000" in got[1, "HR", 1].purpose and "“未知”" in got[1, "HR", 2].question
    assert "a, b, c时" in got[1, "技术面试官", 1].question and "相关算法" in got[2, "技术面试官", 1].question
    assert "x" * 180 + "”" in got[2, "用人经理", 1].question and "尚未披露职责" in got[1, "用人经理", 1].question


def test_tailoring_only_reorders(spark):
    schema = "id int, ready boolean, projects array<struct<id:string,title:string,bullets:array<string>,confirmed:boolean>>, skills array<struct<name:string,level:string,confirmed:boolean>>"
    projects = [("p1", "Web", ["plain", "python tool"], True), ("p2", "Edge", ["nothing", "edge detection", "detection"], True), ("p3", "Draft", ["detection"], False), ("p4", "Empty", [], True)]
    skills = [("go", "done", True), ("python", "done", True), ("edge", "learned", True)]
    df = spark.createDataFrame([(1, True, projects, skills), (2, False, projects, skills), (3, True, [], skills)], schema)
    wanted = F.array(F.lit("det"), F.lit("edge"), F.lit("py"))
    out = prepare.tailored(df, wanted, lambda c: tags(c, WORDS)).persist()
    r = out.collect()
    assert [x.id for x in r] == [1]
    assert [(p.id, p.bullets) for p in r[0].ordered_projects] == [("p2", ["edge detection", "detection", "nothing"]), ("p1", ["python tool", "plain"])]
    assert r[0].ordered_skills == ["python", "go"]
    assert [tuple(c) for c in r[0].changes] == [("Web → Edge", "Edge → Web"), ("go → python", "python → go")]
    assert [(c.pos, c.ref) for c in prepare.cases(out, "id", 1).collect()] == [(0, "project:p2")]
