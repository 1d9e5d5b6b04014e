import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import convo, matching, merge, plan, ranking, tables, tasks, windows
from postmill.sources import feeds, jsonld, robots
from postmill.streaming import streams

BLANK = {f: "" for f in matching.FACTS}


def posting(seq, **more):
    return {"seq": seq, "urls": [], "identity": "", "content_hash": "", "mode": "import", "edited": [], "raw_text": "", "status_validity": "未知", **BLANK, **more}


ROWS = "seq bigint, urls array<string>, identity string, content_hash string, mode string, edited array<string>, raw_text string, status_validity string, " + ", ".join(f"{f} string" for f in matching.FACTS)


def ingest(spark, *rows):
    names = [c.split()[0] for c in ROWS.split(", ")]
    return sorted(merge.ingest(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ROWS)).collect(), key=lambda r: r.entity)


def test_merge_fills_unknown_and_logs_conflicts(spark):
    got = ingest(spark, posting(1, identity="i", salary_raw="未知", title="a", raw_text="x\ny"), posting(2, identity="i", salary_raw="40K", title="b", raw_text="Y\nz", status_validity="有效"), posting(3, identity="i", title="b"))
    assert len(got) == 1 and got[0].salary_raw == "40K" and got[0].title == "a" and got[0].status_validity == "有效"
    assert [tuple(c) for c in got[0].conflicts] == [("title", "a", "b")] and got[0].raw_text == "x\ny\nz"


def test_merge_refresh_keeps_human_edits(spark):
    first = posting(1, urls=["u"], salary_raw="30K", responsibilities="old", edited=["salary_raw"])
    got = ingest(spark, first, posting(2, urls=["u", "v"], salary_raw="50K", responsibilities="new", mode="source_refresh"), posting(3, urls=["v"], responsibilities="third"))
    assert len(got) == 1 and got[0].salary_raw == "30K" and got[0].responsibilities == "new"
    assert sorted(c.field for c in got[0].conflicts) == ["responsibilities", "responsibilities", "salary_raw"] and got[0].urls == ["u", "v"]


def test_merge_is_not_transitive(spark):
    # row 3 shares its link with entity 1 and its identity with entity 2: only the first hit is joined
    got = ingest(spark, posting(1, urls=["u"], identity="a"), posting(2, urls=["w"], identity="b"), posting(3, urls=["u"], identity="b"), posting(4, identity="z"), posting(5))
    assert [(r.entity, r.seqs) for r in got] == [(1, [1, 3]), (2, [2]), (4, [4]), (5, [5])]


def test_merge_does_not_depend_on_partitions(spark):
    rows = [posting(i, urls=[f"u{i % 7}"], identity=f"i{i % 3}" if i % 2 else "", content_hash=f"h{i % 5}", title=f"t{i % 4}") for i in range(40)]
    assert [r.asDict() for r in ingest(spark, *rows)] == [r.asDict() for r in ingest(spark, *rows[::-1])]


def test_merge_follows_chains_of_any_length(spark):
    # row i shares a link with row i - 1 and another with row i + 1 only: one entity, however long the chain
    chain = [posting(i, urls=[f"u{i}", f"u{i + 1}"]) for i in range(1, 101)]
    got = ingest(spark, *chain, posting(200, urls=["v"]), posting(201))
    assert [(r.entity, sorted(r.seqs)) for r in got] == [(1, list(range(1, 101))), (200, [200]), (201, [201])]


def test_line_merge(spark):
    df = spark.createDataFrame([(1, "Duty A\n熟悉 Python\n30-60K", "duty a\n熟悉Python\n40-60K\n\n"), (2, None, ""), (3, "+5%\n-5%\n5.0\n50\nC++\nC#\na-b\na–b\na:b\na：b", None)], "id int, a string, b string")
    got = {r.id: r.text.split("\n") for r in windows.merge_lines(df, "id", ["a", "b"]).collect()}
    assert got[1] == ["Duty A", "熟悉 Python", "30-60K", "40-60K"] and got[2] == [""] and got[3] == ["+5%", "-5%", "5.0", "50", "C++", "C#", "a-b", "a–b", "a:b"]  # full-width forms are the same line


def test_robots(spark):
    text = "User-agent: *\nDisallow: /*?*\nDisallow: /private/*\nAllow: /private/open$\nCrawl-delay: 2"
    named = "User-agent: *\nDisallow: /\n\nUser-agent: other\nUser-agent: collector # us\nAllow: /\nDisallow: /x\nRequest-rate: 1/5"
    rules = robots.rules(spark.createDataFrame([("a", text), ("b", named), ("c", "")], "o string, t string"), "o", "t", "Collector/1.0")
    delays = {r.origin: r.delay for r in rules.collect()}
    assert delays == {"a": 2.0, "b": 5.0, "c": 1.0}
    links = [("a", "https://h/jobs?city=sz", False), ("a", "https://h/private/person", False), ("a", "https://h/private/open", True), ("a", "https://h/", True), ("b", "https://h/x/1", False), ("b", "https://h/y", True), ("c", "https://h/any", True)]
    got = robots.allowed(spark.createDataFrame(links, "o string, u string, want boolean"), "u", "o", rules).collect()
    assert len(got) == len(links) and all(r.allowed == r.want for r in got)
    for o, u, want in links[:4]:
        listed = [(r.kind, r.pattern) for r in rules.where(F.col("origin") == o).collect()]
        assert robots.allowed_one(u.removeprefix("https://h"), listed) == want


def test_json_ld(spark):
    node = {"@type": "JobPosting", "title": "算法", "hiringOrganization": {"name": "X"}, "datePosted": "2026-09-01", "jobLocation": [{"address": {"addressLocality": "深圳", "addressCountry": "中国"}}], "description": "<p>a</p>", "baseSalary": {"currency": "CNY", "value": {"minValue": 40000, "maxValue": 60000, "unitText": "MONTH"}}}
    page = f'<script type="application/ld+json">{json.dumps({"@graph": [node, node]})}</script><script type="application/ld+json">broken</script>'
    jsonld.register(spark)
    spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string").createOrReplaceTempView("_t_pages")
    got = spark.sql("SELECT id, j.* FROM _t_pages, LATERAL job_postings(html, '2026-01-01T00:00:00+00:00') j").collect()
    assert [(r.id, r.city, r.salary_raw, r.published_at, r.status_validity) for r in got] == [(1, "深圳，中国", "CNY 40000–60000 / MONTH", "2026-09-01", "未知")]
    assert jsonld.validity("2020-01-01", datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)) == "已关闭" and jsonld.validity("soon", None) == "未知"
    leaves = spark.sql("""SELECT l.* FROM LATERAL string_leaves('{"a":[{"b":"x"},"y"],"id":"no","n":1}', 'id') l""").collect()
    assert [tuple(r) for r in leaves] == [("a[0].b", "x"), ("a[1]", "y")]


def test_feeds(spark):
    board = json.dumps({"jobs": [{"title": "T", "location": {"name": "SZ"}, "content": "&lt;p&gt;Body&lt;/p&gt;", "updated_at": "2026", "absolute_url": "javascript:x", "metadata": [{"name": "Salary", "value": "40K"}]}]})
    paged = json.dumps([{"text": "L", "descriptionPlain": "d", "categories": {"location": "BJ"}, "salaryRange": {"currency": "USD", "interval": "per-year", "min": 1, "max": 2}, "hostedUrl": "https://h/x"}])
    p = spark.createDataFrame([("s1", None, 200, board), ("s2", None, 200, paged), ("bad/1", None, 200, "[]"), ("s3", None, 404, "")], "source string, company string, status int, payload string")
    b = feeds.read_source("board", p.where("source = 's1'")).first()
    assert (b.company, b.title, b.salary_raw, b.published_at, b.responsibilities, b.source_url, b.raw_text, b.status_validity) == ("未知", "T", "40K", None, "未知", "", "Body", "有效")
    v = feeds.read_source("postings", p.where("source = 's2'")).first()
    assert (v.city, v.salary_raw, v.source_url) == ("BJ", "USD 1–2 / per-year", "https://h/x")
    assert {r.source: r.error for r in feeds.outcomes(p).collect()} == {"s1": None, "s2": None, "bad/1": "bad source name", "s3": "HTTP 404"}
    with pytest.raises(ValueError, match="no reader"):
        feeds.read_source("nothing", p)
    assert [r.skip for r in feeds.page_offsets(spark, 99).collect()][-1] == 1900


def test_matching(spark):
    skills = spark.createDataFrame([(0, "yolo", "", "learned", True, ["检测"]), (1, "c", "done it", "done", True, ["C++"]), (2, "d", "said", "done", False, ["量化"])], "pos int, name string, evidence string, level string, confirmed boolean, tags array<string>")
    projects = spark.createDataFrame([("p", "t", "c", ["b1"], True, ["Python"])], "id string, title string, context string, bullets array<string>, confirmed boolean, tags array<string>")
    required = spark.createDataFrame([("j", t) for t in ("检测", "C++", "Python", "蒸馏", "量化")], "job string, tag string")
    d = matching.dimensions(required, matching.evidence_bank(skills, projects))
    got = {r.tag: (r.match, r.score) for r in d.collect()}
    assert got == {"检测": (matching.LEARNED, 45), "C++": (matching.PRACTISED, 100), "Python": (matching.PRACTISED, 100), "蒸馏": (matching.NO_INFO, None), "量化": (matching.CLAIMED, None)}
    assert tuple(matching.overall(d).first())[1:] == (82, False)  # 245 / 3
    item = plan.plan_items(d, "tag", F.col("match"), F.lit(False), F.lit("p"))
    assert {r.tag: r.hours for r in item.collect()} == {"检测": 3, "C++": 1, "Python": 1, "蒸馏": 2, "量化": 3}
    assert tuple(plan.plan_total(item, "job", 8.0).first())[1:] == (8, 1.0)
    order = spark.range(1).select(matching.by_overlap(F.array(*map(F.lit, "abc")), F.array(F.lit("b")), lambda x: F.array(x)).alias("x")).first().x
    assert order == ["b", "a", "c"]


def test_ranking_treats_zero_as_unknown(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, None, "b"), (3, 5, "c"), (4, 0, "d")], "seq int, score int, updated_at string").withColumn("min_monthly", F.col("score"))
    assert [r.seq for r in ranking.order(df, "score").collect()] == [3, 4, 2, 1] and [r.seq for r in ranking.order(df, "?").collect()] == [4, 3, 2, 1]
    assert ranking.search(df, "UPDATED_AT").count() == 4 and ranking.search(df, "zz").count() == 0  # names are searched too
    ledger = df.select("seq").where("seq = 3")
    assert [r.seq for r in ranking.digest(df, ledger, "seq", [F.desc("seq")], 2).collect()] == [4, 2]


def test_windows(spark):
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(i, "k", t0 + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 299, 300, 301])]
    got = windows.trailing_count(spark.createDataFrame(rows, "id int, k string, ts timestamp"), "k", "ts", 300).orderBy("id").collect()
    assert [r.recent for r in got] == [1, 2, 2, 3]  # exactly 300 s old doesn't count
    row = spark.createDataFrame([("a\nb\nsalary 40K\nc\nd",), ("none",)], "t string").select(windows.context_frame(F.col("t"), lambda x: x.contains("salary")).alias("f")).collect()
    assert [r.f for r in row] == [["a", "b", "salary 40K", "c"], None]


def test_tables(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 9, None)], "k string, seq int, v string")
    assert {r.k: (r.seq, r.v, r.first_seq) for r in tables.latest_by_key(df, ["k"], "seq").collect()} == {"a": (3, "z", 1), "b": (9, None, 9)}
    assert {r.k: r.v for r in tables.insert_or_ignore(df, "k", "v", "seq").collect()}["a"] == "x"
    assert tables.get(spark.createDataFrame([("a", "1")], "key string, value string"), "b", F.lit("d")).first().value == "d"
    made = spark.createDataFrame([(1, 2, None), (2, 2, None)], "k int, v int, w int")
    now = spark.createDataFrame([(1, 2, None), (2, 3, None)], "k int, v int, w int")
    assert {r.k: r.stale for r in tables.stale(made, now, "k", ["v", "w"]).collect()} == {1: False, 2: True}


def test_tasks(spark):
    assert [spark.range(1).select(tasks.run_status(F.lit(f), F.lit(n)).alias("x")).first().x for f, n in ((0, 3), (1, 3), (3, 3), (0, 0))] == ["completed", "partial", "failed", "completed"]
    q = spark.createDataFrame([(2, "queued", 0), (1, "running", 1), (3, "queued", 0)], "seq int, status string, attempts int")
    assert tuple(tasks.claim(q).first()) == (2, "running", 1)


def test_conversation(spark):
    got = spark.createDataFrame([("I own it", 1), ("measured 100 times", 1), ("I measured 100", 1), ("I measured 100 against the baseline", 1), ("my baseline 5", 2), ("no digits", 1)], "a string, n int").select(convo.next_focus(F.col("a"), F.col("n")).alias("f")).collect()
    assert [r.f for r in got] == ["evidence", "ownership", "reliability", "failure analysis", "transfer", "evidence"]
    assert spark.range(1).select(convo.unverified_numbers(F.lit("1 100 7.5%"), F.lit("has 100")).alias("x")).first().x == ["7.5%"]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 2, (i * 37 % 100) * 1_000_000, i % 9 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, key bigint, us bigint, success boolean")
    want = {(r.id, r.allowed) for r in streams.rate_limit_batch(df, 3, 20).collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = streams.run_once(streams.rate_limit(stream, 3, 20), f"file://{tmp_path}/out", "x")
    assert {(r.id, r.allowed) for r in got.collect()} == want


def test_delivery_never_repeats(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in")
    chosen = lambda df, ledger: df.join(ledger, "id", "left_anti")
    for turn in itertools.count():
        streams.deliver(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", chosen)
        if turn == 1:
            spark.range(3, 8).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if turn == 2:
            break
    got = spark.read.parquet(f"{tmp_path}/out/ledger").collect()
    assert sorted(r.id for r in got) == list(range(8))


def test_daily_first_with_watermark(spark, tmp_path):
    ts = [datetime.datetime(2026, 1, d, h) for d in range(1, 6) for h in (0, 1, 2, 20)]
    spark.createDataFrame([(t,) for t in ts], "ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = streams.run_once(streams.daily_first(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in"), "ts", "09:00"), f"file://{tmp_path}/out", "d").collect()
    assert {(str(r.day), r.first.hour) for r in got} >= {("2026-01-01", 1), ("2026-01-02", 1), ("2026-01-03", 1)}
