"""Paged sources, imports under budgets, discovery runs."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import discovery, imports
from postmill.operators.matching import FACTS
from postmill.plans import imports as plans
from postmill.sources import paged
from postmill.streaming.entities import ROW, Entities
from postmill.streaming.publication import Publication


@pytest.fixture
def pages(spark, tmp_path):
    def make(n):
        path = tmp_path / f"rows-{n}.parquet"
        spark.range(n).selectExpr("id", "concat('r', id) AS name").coalesce(1).write.parquet(str(path))
        return str(path)

    return make


@pytest.mark.parametrize("n", [0, 1, 9, 10, 25, 30])
def test_pages_up_to_the_first_short_one(spark, pages, n):
    got = paged.read_pages(spark, "parquet", limit=10, pages=4, path=pages(n), columns="id").collect()
    assert sorted((r.skip + r.pos, r.payload) for r in got) == [(i, f'{{"id": {i}}}') for i in range(n)]


def test_a_source_beyond_its_cap_fails(spark, pages):
    with pytest.raises(Exception, match="more than 20 rows"):
        paged.read_pages(spark, "parquet", limit=10, pages=2, path=pages(20), columns="id").collect()


@pytest.mark.parametrize("n", [0, 10, 25, 305])
def test_without_a_cap_all_pages_are_read(spark, pages, n):
    got = paged.read_pages(spark, "parquet", limit=10, pages=None, path=pages(n), columns="id").collect()
    assert sorted((r.skip + r.pos, r.payload) for r in got) == [(i, f'{{"id": {i}}}') for i in range(n)]


def test_query_beyond_twenty_pages(spark, tmp_path):
    n = 20 * plans.PAGE + 1
    # many row groups in more than one file
    rows = spark.range(0, n, 1, 3).selectExpr("id AS page_id", "concat('https://h/', id) AS url", "'' AS html")
    rows.write.option("parquet.block.size", 65536).option("parquet.page.size", 4096).parquet(f"{tmp_path}/pages.parquet")
    got = plans.q83_paged_source(spark, str(tmp_path))
    assert got.count() == n and got.where(f"skip <> page_id - page_id % {plans.PAGE} OR url <> concat('https://h/', page_id)").isEmpty()


PART = "import bigint, pos bigint, kind string, name string, size bigint, text string, error string"


def test_import_keeps_what_failed_as_warnings(spark):
    rows = [
        (1, 0, "text", None, None, "公司：Ａcme\n岗位职责\nduty", None), (1, 1, "file", "a.txt", 10, "Duty\n城市：深圳", None), (1, 2, "file", "b.pdf", 10, None, "can't be read"),
        (1, 3, "link", "ftp:/bad", None, "never", None), (1, 4, "link", "https://Jobs.example/1?utm_source=x", None, "任职要求\nPython", None), (1, 5, "link", "https://jobs.example/2", None, None, "HTTP 404"),
        (2, 0, "text", None, None, "  ", None), (3, 0, "text", None, None, None, None), (3, 1, "link", "https://jobs.example/3", None, "", None),
    ]
    got = {r["import"]: r for r in imports.import_parts(spark.createDataFrame(rows, PART)).collect()}
    a = got[1]
    assert a.over is None and a.raw_text == "公司:Acme\n岗位职责\nduty\n城市:深圳\n任职要求\nPython" and (a.company, a.city, a.responsibilities, a.requirements) == ("Acme", "深圳", "duty\n城市:深圳", "Python")
    assert a.warnings == ["b.pdf: can't be read", "not a link: ftp:/bad", "https://jobs.example/2: HTTP 404"] and a.attachments == ["a.txt", "b.pdf"]
    assert [tuple(s) for s in a.sources] == [("https://jobs.example/1", "jobs.example", True), ("https://jobs.example/2", "jobs.example", False)]
    assert [(o.kind, o.name) for o in a.originals] == [("text", None), ("file", "a.txt"), ("link", "https://Jobs.example/1?utm_source=x")] and {"company", "city", "published_at"} <= set(a.uncertain_fields)
    assert got[2].over == "nothing" and got[2].raw_text is None and got[3].over is None and got[3].raw_text == ""
    assert imports.import_parts(spark.createDataFrame([], PART)).count() == 0


def test_budgets_name_the_part_that_breaks_them(spark):
    file = lambda i, pos, name="f.txt", size=1: (i, pos, "file", name, size, "x", None)
    rows = [file(1, p) for p in range(7)] + [file(2, p, f"{p}.PNG") for p in range(3)] + [file(3, 0, size=30_000_000), file(3, 1, size=5_999_999), file(3, 2, size=2), file(3, 3, size=9)]
    rows += [(4, p, "link", "https://x.example/", None, "", None) for p in range(6)] + [(5, 0, "text", None, None, "x" * 100_001, None)] + [file(6, p, f"{p}.png") for p in range(2)] + [(6, 9, "text", None, None, "x" * 100_000, None)]
    got = {r["import"]: (r.over, r.at) for r in imports.budgets(spark.createDataFrame(rows, PART)).collect()}
    assert got == {1: ("files", 6), 2: ("images", 2), 3: ("bytes", 2), 4: ("links", 5), 5: ("text", 0)}


def test_discovery_tells_failed_sources_and_goes_on(spark, tmp_path):
    names = [c.split()[0] for c in ROW.split(", ")]
    posting = lambda seq, source, text, url=None: tuple({"seq": seq, "sample": False, "urls": [url] if url else [], "mode": "source_refresh", "edited": [], "raw_text": text, "status_validity": "有效", **dict.fromkeys(FACTS, "")}[n] for n in names) + (source,)
    rows = [posting(1, "a", "keep one", "u1"), posting(2, "a", "drop"), posting(3, "b", "keep ONE"), posting(4, "b", "keep two"), posting(5, "c", "keep three"), posting(6, "off", "keep four")]
    fetched = spark.createDataFrame(rows, ROW + ", source string")
    sources = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("empty", True), ("off", False)], "name string, enabled boolean")
    failures = spark.createDataFrame([("c", "HTTP 500"), ("off", "never asked")], "source string, error string")
    store = Entities(spark, f"file://{tmp_path}/run")
    run = lambda n: discovery.discover(fetched.withColumn("seq", F.col("seq") + 100 * n), failures, sources, F.col("raw_text").contains("keep"), store, n)
    first = run(0)
    assert sorted(map(tuple, first.collect())) == [("a", "completed", None, 2, 1, 1, 0), ("b", "completed", None, 2, 2, 1, 1), ("c", "failed", "HTTP 500", 0, 0, 0, 0), ("empty", "completed", None, 0, 0, 0, 0)]
    row = discovery.run_row(first, spark.range(3)).first()
    assert tuple(row) == ("partial", 4, 2, 1, "c：HTTP 500", 3)
    assert {(r.source, r.new, r.merged) for r in run(1).collect()} == {("a", 0, 1), ("b", 0, 2), ("c", 0, 0), ("empty", 0, 0)}
    assert discovery.discover(fetched, failures, sources.where("name = 'off'"), F.lit(True), store, 2).count() == 0
    assert store.read().count() == 2


def test_digests_tell_nothing_twice(spark, tmp_path):
    where, best = f"file://{tmp_path}/digest", [F.desc("score"), F.col("id")]
    jobs = spark.createDataFrame([(i, i % 3) for i in range(7)], "id bigint, score int")
    tell = lambda n, df=jobs: [r.id for r in discovery.publish_digest(df, best, where, n, spark, k=3).orderBy("place").collect()]
    assert tell(0) == [2, 5, 1] and tell(1) == [4, 0, 3] and tell(1) == [4, 0, 3] and tell(2) == [6] and tell(3) == [] and tell(4, jobs.where("id < 0")) == []
    store = Publication(spark, where)
    assert {r.id for r in store.read("ledger", "id bigint").collect()} == {r.id for r in store.read("digest", "id bigint").collect()} == set(range(7))
