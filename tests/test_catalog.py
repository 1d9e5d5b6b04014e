from pyspark.sql import functions as F

from postmill.operators import catalog, parsing


def test_catalog_and_settings(spark, tmp_path):
    rows = catalog.source_catalog(spark, [{"id": "a", "name": "A", "kind": "board", "reason": "why", "enabled": True}, {"id": "b"}]).collect()
    assert [(r.id, r.message, r.enabled, r.url) for r in rows] == [("a", "why", True, ""), ("b", "", False, "")]
    (tmp_path / "p.json").write_text('{"x":\n 1}')
    got = catalog.json_settings(spark, str(tmp_path), {"profile": "p.json"})
    assert [tuple(r) for r in got.collect()] == [("profile", '{"x":\n 1}')]
    stored = spark.createDataFrame([("profile", None), ("other", "o")], "key string, value string")
    assert sorted(map(tuple, catalog.bootstrap(stored, got).collect())) == [("other", "o"), ("profile", None)]
    assert catalog.lookup(stored, "key", "none").count() == 0


def test_flags_and_display(spark):
    df = spark.createDataFrame([(1, True, "in SZ", None), (2, None, None, True), (3, False, "SZ", False)], "id int, favorite boolean, city string, sample boolean")
    assert [r.id for r in catalog.flagged(df, "favorite", "1").collect()] == [1] and catalog.flagged(df, "favorite", "0").count() == 3 == catalog.flagged(df, "favorite", None).count()
    assert {(r.id, r.local) for r in catalog.by_city(df, "city", "SZ").collect()} == {(1, True), (3, True)}
    one = spark.range(1).select(catalog.chips(F.lit(f" a ，b；{'x' * 28}、c\nd")).alias("c"), catalog.kilobytes(F.lit(1025)).alias("k"), catalog.day_and_time(F.lit("2024-01-01 20:05:00").cast("timestamp")).alias("t"), catalog.day_and_time(F.lit(None).cast("timestamp")).alias("n")).first()
    assert (one.c, one.k, one.t, one.n) == (["a", "b", "c"], 2, "01/02 04:05", "")


def test_board_facts(spark):
    texts = ["Requirements\nproven experience\n2 years of experience\n本科及以上", "Proven experience everywhere\nOur clients hold a Master's thesis\n本科及以上优先\n经验不限", "技能要求：Python\n3年以上开发经验\n福利\n硕士", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [(r.f.requirements, r.f.experience, r.f.education) for r in df.select("id", parsing.board_facts(parsing.html_blocks(F.coalesce("t", F.lit("")))).alias("f")).orderBy("id").collect()]
    assert got[0] == ("Requirements\nproven experience\n2 years of experience\n本科及以上", "proven experience\n2 years of experience", "本科及以上")
    assert got[1] == ("", "经验不限", "本科及以上优先")
    assert got[2] == ("技能要求：Python\n3年以上开发经验", "3年以上开发经验", "")
    assert got[3] == ("", "", "")
