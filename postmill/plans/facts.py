"""Queries over single facts, documents for one posting, catalogs and display forms, registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, text, urls
from ..operators import catalog, matching, prepare, ranking, tables
from ..sources import feeds
from .queries import _t, _utc, query
from .reports import TERMS, _postings, _projects, _skills


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 9 WHEN 1 THEN o_custkey % 9 WHEN 2 THEN o_custkey % 9 END::INT AS years, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate < TIMESTAMP '1995-06-17' END AS expired,
  CASE o_orderkey % 3 WHEN 0 THEN 'CNY ' || o_custkey || '–? / MONTH' WHEN 1 THEN 'CNY ' || o_custkey || '–' || o_orderkey || ' / MONTH' ELSE 'CNY 未知 / 周期未知' END AS pay FROM orders
""")
def q87_single_facts(spark, d):
    o = _t(spark, d, "orders")
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 9).cast("string")
    told = F.when(k % 4 == 0, F.concat(n, F.lit("-12 年以上"))).when(k % 4 == 1, F.concat(F.lit("at least "), n, F.lit(" years"))).when(k % 4 == 2, F.concat(n, F.lit("年"))).otherwise("years of it")
    until = F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    low, high = F.when(k % 3 < 2, F.col("o_custkey")), F.when(k % 3 == 1, k)
    return o.select("o_orderkey", dates.least_years(told).alias("years"), dates.expired(until, F.lit("1995-06-17").cast("timestamp")).alias("expired"), money.structured_salary(F.lit("CNY"), low, high, F.when(k % 3 < 2, "MONTH")).alias("pay"))


@query(r"""
SELECT page_id, regexp_full_match(split_part(split_part(url, '://', 2), '.', 1), '[A-Za-z0-9_-]{1,100}') AS slug, len(list_filter(string_split_regex(url || ' ' || page_id || chr(10) || url, '\s+'), lambda x: x <> ''))::BIGINT AS n_links,
  replace(replace(replace(replace(url || '<' || chr(10) || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') AS escaped,
  sha256('{"page_id":' || page_id || ',"none":null}') AS signature, substr(sha256(page_id || '|'), 1, 32) AS stable_id FROM pages
""")
def q88_links_and_signatures(spark, d):
    p = _t(spark, d, "pages").withColumn("none", F.lit(None).cast("string"))
    both = F.concat("url", F.lit(" "), F.col("page_id").cast("string"), F.lit("\n"), "url")
    return p.select("page_id", urls.slug_ok(F.substring_index(F.substring_index("url", "://", -1), ".", 1)).alias("slug"), F.size(urls.split_links(both)).cast("bigint").alias("n_links"), text.escape_html(F.concat("url", F.lit("<\n>"))).alias("escaped"), tables.signature(["page_id", "none"]).alias("signature"), catalog.stable_id(F.col("page_id"), F.col("none")).alias("stable_id"))


_BY = {"score": "CASE WHEN o_custkey % 50 = 0 THEN -1 ELSE o_custkey % 50 END DESC", "salary": "CASE WHEN floor(o_totalprice / 1000) = 0 THEN -1 ELSE floor(o_totalprice / 1000) END DESC", "updated": "o_orderdate DESC", "": "o_orderkey DESC"}


@query(" UNION ALL ".join(f"(SELECT '{by}' AS sort, row_number() OVER (ORDER BY {key}, o_orderkey DESC) AS place, o_orderkey AS seq FROM orders QUALIFY place <= 100)" for by, key in _BY.items()))
def q89_listing_orders(spark, d):
    """The first hundred postings in each order of the listing."""
    from pyspark.sql import Window

    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("score"), F.floor(F.col("o_totalprice") / 1000).alias("min_monthly"), F.col("o_orderdate").alias("updated_at"))
    key = {"score": F.coalesce(F.nullif("score", F.lit(0)), F.lit(-1)).desc(), "salary": F.coalesce(F.nullif("min_monthly", F.lit(0)), F.lit(-1)).desc(), "updated": F.desc("updated_at"), "": F.desc("seq")}
    each = [(ranking.order(o, by) if by else tables.newest_first(o)).limit(100).select(F.lit(by).alias("sort"), F.row_number().over(Window.orderBy(key[by], F.desc("seq"))).cast("bigint").alias("place"), "seq") for by in _BY]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


@query(f"""
WITH b AS (SELECT 'skill:' || item_id AS ref, substr(text, 1, 24) AS told, CASE WHEN item_id % 4 = 1 THEN 'done' WHEN item_id % 4 = 2 THEN 'learned' ELSE 'unknown' END AS level, item_id % 8 = 1 AS confirmed, item_id % 3 <> 0 AS has_detail FROM benchmark WHERE item_id % 4 <> 0
  UNION ALL SELECT 'project:' || item_id, substr(text, 1, 30), 'done', item_id % 8 = 0, item_id % 16 <> 0 FROM benchmark WHERE item_id % 4 = 0),
v AS (SELECT unnest(['articles', 'joins', 'place', 'past']) AS tag),
t AS (SELECT tag, CASE tag WHEN 'articles' THEN '(the|der)' WHEN 'joins' THEN '(and|und)' WHEN 'place' THEN '(de|la)' ELSE 'was' END AS p FROM v),
e AS (SELECT tag, string_agg(ref, ',' ORDER BY ref) AS refs, CASE WHEN bool_or(level = 'done' AND confirmed AND has_detail) THEN '{matching.PRACTISED}' WHEN bool_or(level = 'done') THEN '{matching.CLAIMED}' WHEN bool_or(level = 'learned') THEN '{matching.LEARNED}' ELSE '{matching.NO_INFO}' END AS match
  FROM b, t WHERE regexp_matches(told, '(^|[^a-zA-Z])' || p || '($|[^a-zA-Z])', 'i') GROUP BY tag)
SELECT doc_id AS job, tag, coalesce(match, '{matching.NO_INFO}') AS match, CASE match WHEN '{matching.PRACTISED}' THEN 100 WHEN '{matching.LEARNED}' THEN 45 END AS score, coalesce(refs, '') AS refs
FROM documents JOIN t ON regexp_matches(text, '(^|[^a-zA-Z])' || p || '($|[^a-zA-Z])', 'i') LEFT JOIN e USING (tag)
""")
def q90_dimensions(spark, d):
    some = {k: TERMS[k] for k in ("articles", "joins", "place", "past")}
    skills = _skills(spark, d).withColumn("tags", text.tags(F.col("name"), some))
    projects = _projects(spark, d).withColumn("tags", text.tags(F.array_join("skills", " "), some))
    required = _t(spark, d, "documents").select(F.col("doc_id").alias("job"), F.explode(text.tags(F.col("text"), some)).alias("tag"))
    dims = matching.dimensions(required, matching.evidence_bank(skills, projects))
    return dims.select("job", "tag", "match", "score", F.array_join("evidence", ",").alias("refs"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '30-60K' WHEN 1 THEN '月薪45-60K' WHEN 2 THEN '20-30K' WHEN 3 THEN '未披露' ELSE '未披露' END AS pay, CASE WHEN doc_id % 7 <> 0 THEN lang ELSE '未知' END AS city, CASE WHEN text = '' THEN '尚未披露职责' ELSE substr(text, 1, 180) END AS duties FROM documents)
SELECT doc_id AS job, sha256('岗位标注“' || pay || '”，固定税前月薪的范围是多少？额外薪数、奖金与股权是否另计？' || '工作地点标注为“' || city || '”，出差、驻场和到岗安排分别是什么？' || '针对“' || duties || '”，入职前三个月最主要的交付和验收标准是什么？') AS asked, 6::BIGINT AS n FROM d
""")
def q91_questions(spark, d):
    q = prepare.questions(_postings(spark, d), "job", F.array(F.lit("x")))
    first = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.when(F.col("audience") == "HR", 0).when(F.col("audience") == "用人经理", 1).otherwise(2).alias("a"), "priority", "question"))), 1, 3), lambda x: x["question"]), "")
    return q.groupBy("job").agg(F.sha2(first, 256).alias("asked"), F.count("*").alias("n"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'two|one' ELSE 'one|two' END AS projects, CASE WHEN p_size % 3 = 0 THEN 'odd,plain' ELSE 'plain,odd' END AS skills, CASE WHEN p_size % 2 = 0 THEN 'project:b' ELSE 'project:a' END AS first_case FROM part WHERE p_size % 5 <> 0
""")
def q92_tailored(spark, d):
    """Profiles made from parts: the projects and skills that a part's size asks for come first."""
    part, n = _t(spark, d, "part"), F.col("p_size")
    project = lambda i, title, told: F.struct(F.lit(i).alias("id"), F.lit(title).alias("title"), F.array(F.lit(told)).alias("bullets"), F.lit(True).alias("confirmed"))
    skill = lambda name, level="done": F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"), F.lit(True).alias("confirmed"))
    rows = part.select(F.col("p_partkey").alias("id"), n.alias("n"), (n % 5 != 0).alias("ready"), F.array(project("a", "one", "the"), project("b", "two", "and")).alias("projects"), F.array(skill("plain"), skill("odd"), skill("learning", "learned")).alias("skills"))
    asked = F.array_compact(F.array(F.when(F.col("n") % 2 == 0, "joins"), F.when(F.col("n") % 3 == 0, "odd")))
    own = {"joins": ["and"], "odd": ["odd"]}
    out = prepare.tailored(rows, asked, lambda x: text.tags(x, own))
    names = F.array_join(F.transform("ordered_projects", lambda p: p["title"]), "|")
    first = prepare.cases(out, "id").where("pos = 0").select("id", F.col("ref").alias("first_case"))
    return out.select("id", names.alias("projects"), F.array_join("ordered_skills", ",").alias("skills")).join(first, "id")


@query("""
SELECT doc_id AS id, 'Acme' AS company, 'Title ' || doc_id AS title, 'What you''ll do' || chr(10) || 'Build things' || chr(10) || 'And run them' AS duties, CASE WHEN doc_id % 2 = 0 THEN 'Minimum Qualifications' || chr(10) || 'Python' || chr(10) || '3+ years of experience' || chr(10) || 'Master''s degree preferred' ELSE '未知' END AS requirements,
  CASE WHEN doc_id % 2 = 0 THEN '3+ years of experience' ELSE '未知' END AS experience, CASE WHEN doc_id % 2 = 0 THEN 'Master''s degree preferred' ELSE '未知' END AS education, CASE WHEN doc_id % 3 = 0 THEN '40K' ELSE '未知' END AS pay, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://x.example/' || doc_id END AS link FROM documents
""")
def q93_board(spark, d):
    """A board's payload for each document, read into postings with their sections."""
    i, whole = F.col("doc_id"), F.col("doc_id").cast("string")
    wanted = F.when(i % 2 == 0, "<h3>Minimum Qualifications</h3><ul><li>Python</li><li>3+ years of experience</li><li>Master's degree preferred</li></ul>").otherwise("<h3>Benefits</h3><p>lunch</p>")
    content = F.concat(F.lit("<p>We are Acme</p><p><strong>What you'll do</strong></p><ul><li>Build things</li><li>And run them</li></ul>"), wanted, F.lit("<h3>About us</h3><p>Years of success</p>"))
    job = F.struct(F.concat(F.lit("Title "), whole).alias("title"), F.struct(F.lit("SZ").alias("name")).alias("location"), content.alias("content"), F.when(i % 4 == 0, "javascript:x").otherwise(F.concat(F.lit("https://x.example/"), whole)).alias("absolute_url"), F.array(F.struct(F.lit("Salary").alias("name"), F.when(i % 3 == 0, "40K").alias("value"))).alias("metadata"))
    payloads = _t(spark, d, "documents").select(whole.alias("source"), F.lit("Acme").alias("company"), F.lit(200).alias("status"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    b = feeds.read_source("board", payloads)
    return b.select(F.col("source").cast("bigint").alias("id"), "company", "title", F.col("responsibilities").alias("duties"), "requirements", "experience", "education", F.col("salary_raw").alias("pay"), F.col("source_url").alias("link"))


@query("""
SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'bad source name' WHEN event_type = 'error' THEN 'HTTP 500' WHEN event_type = 'view' THEN 'not JSON' END AS error FROM events
""")
def q94_outcomes(spark, d):
    e, u = _t(spark, d, "events"), F.col("user_id")
    ids = F.col("event_id").cast("string")
    payloads = e.select(F.concat(F.when(u % 9 == 0, "a/").otherwise("s"), ids).alias("source"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.when(F.col("event_type") == "view", "{").otherwise("[]").alias("payload"))
    return feeds.outcomes(payloads).select(F.regexp_extract("source", r"\d+", 0).cast("bigint").alias("event_id"), "error")


@query("""
WITH s AS (SELECT s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier)
SELECT s_suppkey, s_nationkey % 5 = 0 AS "local", (ceil(s_acctbal / 1024))::BIGINT AS kb, array_to_string(list_filter([s_name, 'n' || s_nationkey], lambda x: len(x) < 28), '|') AS chips FROM s WHERE s_acctbal > 0 AND s_suppkey % 3 <> 0
""")
def q95_display(spark, d):
    s = _t(spark, d, "supplier").withColumns({"sample": F.col("s_acctbal") <= 0, "city": F.when(F.col("s_nationkey") % 5 == 0, "in SZ").otherwise("elsewhere"), "favorite": F.when(F.col("s_suppkey") % 3 != 0, True)})
    rows = catalog.by_city(catalog.flagged(s, "favorite", "true"), "city", "SZ")
    told = catalog.chips(F.concat("s_name", F.lit("；；"), F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("，"), F.lit("x" * 40)))
    return rows.select("s_suppkey", "local", catalog.kilobytes(F.col("s_acctbal")).alias("kb"), F.array_join(told, "|").alias("chips"))


@query("""
SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m/%d %H:%M') AS shown FROM events
""")
def q96_display_times(spark, d):
    return _utc(_t(spark, d, "events")).select("event_id", catalog.day_and_time(F.col("ts")).alias("shown"))


@query("""
SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
""")
def q97_bootstrap(spark, d):
    stored = _t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return catalog.bootstrap(stored, _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def q98_lookup(spark, d):
    return catalog.lookup(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query("""
WITH g AS (SELECT o_custkey AS digest_id, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)
SELECT digest_id, array_to_string(list_transform(ids, lambda x, i: i || '. ' || CASE WHEN x % 3 = 0 THEN 'gone' ELSE 'order ' || x END), chr(10)) AS body FROM g
""")
def q99_digest_body(spark, d):
    o = _t(spark, d, "orders")
    digests = o.groupBy(F.col("o_custkey").alias("digest_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    items = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"))
    return ranking.digest_body(ranking.show_digest(digests, items, "ids", "id", "label", "gone"), "label")
