import datetime

from pyspark.sql import functions as F

from postmill.operators import listing, merge, parsing, windows

DATES = """2024-01-01 2024-01-01T25:61 20240101 2024-01-01T10 2024-02-30 2024-02-29 2023-02-29 2024-W05-3 2024W053 2024-W05 2024-W53-1 2020-W53-7 2024-01-01T10:00Z 2024-0101 202401-01 2024-01-01T1000
2024-01-01T10:0030 2024-01-01T10:00:60 0000-01-01 2024-W05-8 2024-01-01T 2024-01-01T10:00:00,5 2024-01-01T10:00+0800 2024-01-01T10:00:00.123456+08:00 2024-01-01x10:00 soon 01.02.2024 2024-13-01 2024-1-1""".split()


def test_dates_are_those_of_iso(spark):
    def good(x):
        try:
            return bool(datetime.datetime.fromisoformat(x.replace("Z", "+00:00")))
        except ValueError:
            return False

    rows = [*DATES, "2024-01-01 10:00:00", "", " ", "未知", None]
    got = [r.d for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", listing.iso_date(F.col("t"), "未知").alias("d")).orderBy("i").collect()]
    assert got == [*[x if good(x) else None for x in DATES], "2024-01-01 10:00:00", "", "", "", ""]


def test_identity_ignores_form_case_and_white_space(spark):
    names = ["ＡＢＣ", "ABC", "AB C", "a b\tc", "Straße", "STRASSE", "深　圳", "深圳", "未知", "", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.x for r in rows.select("i", listing.identity([F.col("n"), F.lit("x")], ["未知"], F.col("i") < 0).alias("x")).orderBy("i").collect()]
    assert len(set(got[:4])) == 1 and got[4] == got[5] and got[6] == got[7] and got[8:] == [None] * 3 and len({got[0], got[4], got[6]}) == 3


def test_lines_merge_as_one_form(spark):
    a, b = "职责：模型 训练\n３０-60K\r\nＣ++ dev", "职责:模型训练\n30-60k\n40-60K\nStraße\nSTRASSE"
    got = windows.merge_lines(spark.createDataFrame([(1, a, b)], "id int, a string, b string"), "id", ["a", "b"]).first().text
    assert got == merge.merge_texts([a, b]) == "职责:模型训练\n30-60K\nC++ dev\n40-60K\nStraße"


def test_headings_of_requirements(spark):
    heads = ["技能要求", "基本要求：", "一、优先条件", "任职资格", "加分项"]
    df = spark.createDataFrame([(i, f"岗位职责\nduty\n{h}\nneed") for i, h in enumerate(heads)], "i int, t string")
    got = df.select("i", parsing.board_sections(parsing.html_blocks("t")).alias("s")).orderBy("i").collect()
    assert [r.s.requirements for r in got] == [[h, "need"] for h in heads] and all(r.s.duties == ["岗位职责", "duty"] for r in got)
