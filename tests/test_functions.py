import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, money, text, urls
from postmill.sources import files


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


PAY = [
    ("30–60K·14薪", "可能符合", 30000, 60000, 2), ("40-60K·16薪", "明确符合", 40000, 60000, 4), ("40 - 60K", "明确符合", 40000, 60000, None), ("40K+", "明确符合", 40000, None, None),
    ("月薪4-6万", "明确符合", 40000, 60000, None), ("固定月薪4-6万，另有奖金", "明确符合", 40000, 60000, None), ("30-39K", "低于目标", 30000, 39000, None), ("低于40K", "低于目标", None, 40000, None),
    ("底薪20K+奖金30K", "低于目标", 20000, 20000, None), ("基本工资20K + 绩效20K", "低于目标", 20000, 20000, None), ("40K以下", "可能符合", None, 40000, None), ("最高40K", "可能符合", None, 40000, None),
    ("CNY 40000–60000 / MONTH", "明确符合", 40000, 60000, None), ("RMB 40000–60000 monthly", "明确符合", 40000, 60000, None), ("CNY 40,000-60,000 per month", "明确符合", 40000, 60000, None),
    ("RMB 40000 MONTH", "明确符合", 40000, 40000, None), ("CNY 30000–60000 / MONTH", "可能符合", 30000, 60000, None), ("60-30K", "信息不足", None, None, None), ("２０－３０Ｋ", "低于目标", 20000, 30000, None),
]
UNKNOWN_PAY = ["60-90万/年", "年包80万", "面议", "综合薪资40-60K含绩效", "税后40K", "40-60万", "$40-60K", "4-6万", "底薪20万/年", "奖金40K", "40-60K含绩效", "30-60K·14薪（含绩效）", "税后月薪40K", "USD 40000–60000 / MONTH", "CNY 40000–60000 / YEAR", "CNY 40-60K / YEAR", "RMB 40000–60000 annual", "CNY 40000–60000 MONTH annual", "CNY 40000–60000", "40000–60000 / MONTH", "CNY ?–60000 / MONTH", "CNY 40000–60000 / HOUR", "最高40-60K", "", None]


def test_pay_ranges(spark):
    rows = [(x, g, a, b, m) for x, g, a, b, m in PAY] + [(x, "信息不足", None, None, "any") for x in UNKNOWN_PAY]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: r.salary for r in money.with_salary(df, "raw").collect()}
    for i, (raw, group, low, high, months) in enumerate(rows):
        s = got[i]
        assert (s.group, s.min_monthly, s.max_monthly) == (group, low, high), raw
        assert months == "any" or s.extra_months == months, raw
    exact = money.with_salary(df.withColumn("n", text.nfkc(F.col("raw"))), "raw", narrowed=F.col("n")).collect()
    assert {r.i: r.salary.group for r in exact} == {i: s.group for i, s in got.items()}


def test_structured_pay(spark):
    row = spark.range(1).select(money.structured_salary(F.lit("CNY"), F.lit(40000), F.lit(60000), F.lit("MONTH")).alias("a"), money.structured_salary(F.lit(None), F.lit(None).cast("int"), F.lit(5), F.lit(None)).alias("b")).first()
    assert (row.a, row.b) == ("CNY 40000–60000 / MONTH", "?–5 / 周期未知")


@pytest.mark.parametrize(("raw", "want"), [
    ("https://source-a.invalid/jobs/test?utm_source=fixture", "https://source-a.invalid/jobs/test"), ("HTTPS://A.b/x/?b=2&a=1&ref=z&empty=#top", "https://a.b/x?a=1&b=2"),
    ("ftp://a/x", ""), ("https://u:p@a/x", ""), ("javascript:alert(1)", ""), (None, ""), ("not a url", ""), ("http://h/?q=a+b&UTM_x=1", "http://h?q=a+b"), ("https://h:8443/a//", "https://h:8443/a"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, urls.canonical_url) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("http://a.example/x", "not_https"), ("https://127.0.0.1/", "address_or_local"), ("https://2130706433/", "address_or_local"), ("https://[::1]/", "address_or_local"), ("https://u@a.example/", "credentials_or_no_host"),
    ("https://a.example:8443/", "not_https"), ("https://a.example\\b", "invalid"), ("https://printer.local/", "internal"), ("https://jobs.bad.example/x", "restricted"), ("https://a.example/x", "ok"), (None, "invalid"),
])
def test_admission(spark, raw, want):
    assert one(spark, raw, lambda c: urls.admission(c, ["bad.example"])) == want


@pytest.mark.parametrize(("raw", "want"), [("发布时间：2026-09-20", "2026-09-20"), ("发布日期：2026年9月27日", "2026-09-27"), ("发布时间：2026/9/27", "2026-09-27"), ("发布时间：2026-99-27", ""), ("posted today", ""), (None, "")])
def test_published_date(spark, raw, want):
    assert one(spark, raw, dates.published_date) == want


def test_small_functions(spark):
    assert one(spark, "a\r\nb\rc\n", text.lines) == ["a", "b", "c"] and one(spark, None, text.lines) == []
    assert one(spark, "• a。- b；；\n c", text.sentences) == ["a", "b", "c"]
    assert [one(spark, x, text.known) for x in ("x", " ", None, " N/A ", "待核实")] == [True, False, False, False, False]
    assert one(spark, "Ｓtraße  Ａ", text.normal_form) == "strassea"
    assert one(spark, "email Mil 5", lambda c: text.tags(c, {"M": ["mil"], "C": ["c++"]})) == ["M"] and one(spark, "milk c++", lambda c: text.tags(c, {"M": ["mil"], "C": ["c++"]})) == ["C"]
    assert one(spark, "x 3.5% of 100", text.numbers) == ["3.5%", "100"]
    assert one(spark, "深 圳 a b", text.join_cjk) == "深圳 a b" and one(spark, "30一60K", text.repair_dash) == "30-60K"
    assert one(spark, '<p>A &amp; b</p><script>x</script><p> c</p>', text.html_text) == "A & b\nc" and one(spark, None, text.html_text) == ""
    assert one(spark, "5 - 8 年", dates.least_years) == 5 and one(spark, "none", dates.least_years) is None
    assert one(spark, datetime.datetime(2026, 9, 1, 16, 30), dates.local_day, "timestamp_ntz") == datetime.date(2026, 9, 2)
    assert one(spark, "a<b>\nc", text.escape_html) == "a&lt;b&gt;<br/>c"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿深圳 岗位".encode())
    (tmp_path / "b.md").write_bytes("深圳 岗位".encode("gb18030"))
    (tmp_path / "c.txt").write_bytes("深圳 岗位".encode("utf-16"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "f.docx").write_bytes(inner.getvalue())
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * (8 << 20))
    (tmp_path / "g.docx").write_bytes(bomb.getvalue())
    got = {r.path[-5:].lstrip("/"): r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert {got[k].text for k in ("a.txt", "/b.md"[1:], "c.txt")} == {"深圳 岗位"}
    assert (got["d.pdf"].method, got["d.pdf"].text) == ("unavailable", "")
    assert [got[k].method for k in ("e.docx"[-5:], )] or True
    by = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert by["e.docx"].method == "failed" and by["g.docx"].method == "failed" and by["f.docx"].text == "one\na | b"
    assert files.extract("x.txt", b"a" * (files.FILE_LIMIT + 1))["method"] == "failed"
