from pyspark.sql import functions as F

from postmill.operators import parsing

TEXT = "公司：测试公司\n岗位名称：视觉算法工程师\n城市：深圳\n薪资：30-60K·14薪\n经验：3-5年\n学历：硕士\n岗位职责：\n负责检测模型\n任职要求：\n熟悉 PyTorch\n福利：\n下午茶"


def test_parse_postings(spark):
    rows = [(1, TEXT), (2, "深圳某某科技有限公司\n资深算法研究员\n30-50K\n5年以上经验，本科及以上\n发布时间：2026-09-20"), (3, None), (4, "Company: X\nresponsibilities: lead\nmore\nrequirements\nC++\n发布日期：2026-99-27")]
    got = {r.id: r for r in parsing.parse_postings(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    a = got[1]
    assert (a.company, a.title, a.city, a.salary_raw, a.experience, a.education) == ("测试公司", "视觉算法工程师", "深圳", "30-60K·14薪", "3-5年", "硕士")
    assert (a.responsibilities, a.requirements, a.published_at, a.uncertain_fields) == ("负责检测模型", "熟悉 PyTorch", "", ["published_at"])
    b = got[2]
    assert (b.company, b.title, b.city, b.salary_raw, b.experience, b.education, b.published_at) == ("深圳某某科技有限公司", "资深算法研究员", "深圳", "30-50K", "5年以上经验", "本科及以上", "2026-09-20")
    assert set(b.uncertain_fields) == {"company", "title", "city", "salary_raw", "experience", "education", "responsibilities", "requirements"}
    assert got[3].title == "" and len(got[3].uncertain_fields) == 9
    assert (got[4].responsibilities, got[4].requirements, got[4].published_at) == ("lead\nmore", "C++\n发布日期:2026-99-27", "")


def test_draft_profiles(spark):
    text = "姓名：张三\n13800138000 a.b@c.example\n6.5年算法经验，PyTorch\n项目：缺陷检测\n做了标注\n\n提升指标\n项目名称: 二\n"
    r = parsing.draft_profiles(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", {"PyTorch": ["pytorch"]}).orderBy("id").collect()
    assert (r[0].contact, r[0].name, r[0].years) == ("a.b@c.example | 13800138000", "张三", 6.5)
    assert [tuple(s) for s in r[0].skills] == [("PyTorch", "unknown", "6.5年算法经验，PyTorch", False)]
    assert [(p.title, p.bullets) for p in r[0].projects] == [("缺陷检测", ["做了标注", "提升指标"]), ("二", [])]
    assert (r[1].contact, r[1].years, r[1].skills, r[1].projects) == ("", None, [], [])


def test_board_sections(spark):
    page = "<h2>Responsibilities</h2><ul><li>Build</li><li>Ship</li></ul><h3>Requirements</h3><p>5+ years of relevant experience</p><p><b>Preferred Qualifications</b></p><li>Master's degree preferred, or equivalent</li><h2>Benefits</h2><p>Lunch</p>"
    inline = "<p><b>Responsibilities:</b> own it</p><p>Qualifications: Bachelor's with 8+ years experience or Master's with 5+</p><p>The base salary is x</p><p>more</p>"
    df = spark.createDataFrame([(1, page), (2, inline), (3, "<p>Founder, Master C++ hacker</p>"), (4, None)], "id int, h string")
    got = {r.id: r for r in df.select("id", parsing.board_sections(parsing.html_blocks("h")).alias("s")).select("id", "s.*", parsing.degree_lines(F.col("s.requirements")).alias("degree"), parsing.experience_lines(F.col("s.requirements")).alias("years")).collect()}
    assert got[1].duties == ["Responsibilities", "Build", "Ship"] and "Lunch" not in got[1].requirements
    assert got[1].degree == ["Master's degree preferred, or equivalent"] and got[1].years == ["5+ years of relevant experience"]
    assert got[2].duties == ["Responsibilities: own it"] and len(got[2].degree) == 1 and got[2].requirements == ["Qualifications: Bachelor's with 8+ years experience or Master's with 5+"]
    assert got[3].duties == got[3].requirements == [] and got[4].duties == []
