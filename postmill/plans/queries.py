"""The library's operators bound to the test tables: one query each, over whole tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text, urls
from ..operators import convo, matching, merge, parsing, plan, ranking, tables, tasks, windows
from ..sources import jsonld, robots
from ..storage import shared_dir
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A folder of its own for each call, where all executors see it."""
    return f"{shared_dir(spark)}/postmill/{uuid.uuid4().hex}"


#: Words of part names as a vocabulary.
VOCABULARY = {"temperature": ["hot", "cold"], "colour": ["red", "blue"], "size": ["large", "small"], "fastener": ["bolt", "ring", "rod"], "machine": ["gear", "widget", "gizmo"], "age": ["old", "new"]}
ROLES = {"quality": ["quality", "the"], "team": ["of", "und"], "place": ["de", "la"]}


@query("""
SELECT o_orderkey AS seq, o_orderpriority = '1-URGENT' AS in_city, o_totalprice >= 200000 AS confirmed, nullif(o_custkey % 101, 0) AS score
FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000 AND o_orderkey % 5 <> 0
ORDER BY in_city DESC, confirmed DESC, coalesce(score, 0) DESC, seq DESC LIMIT 12
""")
def q01_digest_topk(spark, d):
    o = _t(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderpriority") == "1-URGENT").alias("in_city"), (F.col("o_totalprice") >= 200000).alias("confirmed"), F.nullif(F.col("o_custkey") % 101, F.lit(0)).alias("score"), "o_orderstatus", "o_totalprice")
    open_ = rows.where(ranking.open_posting(F.lit(False), F.col("o_orderstatus") == "P", F.col("o_orderstatus"), F.col("o_totalprice") < 50000, ["X"]))
    ledger = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("seq"))
    return ranking.digest(open_, ledger, "seq", ranking.digest_ranking("in_city", "confirmed", "score", "seq")).select("seq", "in_city", "confirmed", "score")


@query("""
SELECT o_orderkey, c_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
WHERE contains(lower(concat_ws('|', c_name, c_mktsegment, o_orderpriority, o_orderstatus)), 'build') AND o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urg')
""")
def q02_listing_search(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = ranking.search(j, "BUILD", F.concat_ws("|", "c_name", "c_mktsegment", "o_orderpriority", "o_orderstatus"))
    return ranking.equals(found, o_orderstatus="O", o_orderpriority="").where(F.lower("o_orderpriority").contains("urg")).select("o_orderkey", "c_name", "c_mktsegment", "o_orderpriority")


@query("""
SELECT count(*) AS total, count(*) FILTER (CAST(o_orderdate + INTERVAL 8 HOUR AS DATE) = DATE '1997-05-28') AS new_today,
  count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders
""")
def q03_dashboard_counts(spark, d):
    return ranking.dashboard(_t(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"], dates.local_day(F.col("o_orderdate")), F.lit("1997-05-28").cast("date"))


_CANONICAL = r"""
p AS (SELECT page_id, url, lower(regexp_extract(url, '^([^:]+)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, url, s, h, path, coalesce(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT regexp_matches(lower(x), '^(from|source|ref|referrer|trackingid)=') AND regexp_matches(x, '=.'))), '&'), '') AS q2 FROM p),
canonical AS (SELECT page_id, url, s || '://' || h || path || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END AS link, h FROM c)
"""


@query(f"WITH {_CANONICAL} SELECT page_id, link FROM canonical")
def q04_canonical_url(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("link"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10000) AS BIGINT) AS lo, CAST(floor(o_totalprice / 10000) AS BIGINT) + 15 AS hi, o_orderkey % 6 AS v FROM orders)
SELECT o_orderkey,
  CASE WHEN v IN (2, 3) THEN '信息不足' WHEN v = 5 THEN CASE WHEN lo * 1000 >= 40000 THEN '可能符合' ELSE '低于目标' END WHEN lo * 1000 >= 40000 THEN '明确符合' WHEN v = 4 OR hi * 1000 >= 40000 THEN '可能符合' ELSE '低于目标' END AS pay_group,
  CASE WHEN v IN (2, 3, 5) THEN NULL ELSE lo * 1000 END AS min_monthly,
  CASE WHEN v IN (2, 3, 4) THEN NULL WHEN v = 5 THEN lo * 1000 ELSE hi * 1000 END AS max_monthly,
  CASE WHEN v = 0 THEN 2 END AS extra_months
FROM o
""")
def q05_salary_group(spark, d):
    o = _t(spark, d, "orders").withColumns({"lo": F.floor(F.col("o_totalprice") / 10000), "v": F.col("o_orderkey") % 6}).withColumn("hi", F.col("lo") + 15)
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    shapes = [F.concat(lo, F.lit("–"), hi, F.lit("K·14薪")), F.concat(F.lit("月薪："), lo, F.lit("-"), hi, F.lit("Ｋ")), F.concat(lo, F.lit("-"), hi, F.lit("万/年")), F.concat(F.lit("税后"), lo, F.lit("-"), hi, F.lit("K")), F.concat(lo, F.lit("K+")), F.concat(lo, F.lit("K以下"))]
    raw = shapes[0]
    for i, shape in enumerate(shapes[1:], 1):
        raw = F.when(F.col("v") == i, shape).otherwise(raw)
    paid = money.with_salary(o.withColumn("raw", raw), "raw")
    return paid.select("o_orderkey", F.col("salary.group").alias("pay_group"), "salary.min_monthly", "salary.max_monthly", "salary.extra_months")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(f"""
WITH {_LINES}, k AS (SELECT doc_id, pos, line, regexp_replace(lower(line), '\\s', '', 'g') AS key FROM l)
SELECT doc_id, pos, line FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1
""")
def q06_line_dedup(spark, d):
    return windows.first_lines(windows.line_rows(_t(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(r"""
WITH s AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '[\n。；;]+'), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), lambda x: trim(x, ' •-' || chr(9))) AS a FROM documents)
SELECT doc_id, len(a)::BIGINT AS n, a[1] AS first FROM s
""")
def q07_sentences(spark, d):
    s = _t(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("a"))
    return s.select("doc_id", F.size("a").cast("bigint").alias("n"), F.try_element_at("a", F.lit(1)).alias("first"))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''regexp_matches(p_name, '(^|[^a-zA-Z]){t}($|[^a-zA-Z])', 'i')''' for t in terms)} THEN '{tag}' END" for tag, terms in VOCABULARY.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT p_partkey, array_to_string({_TAGS}, ',') AS tags FROM part")
def q08_dict_tagging(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(text.tags(F.col("p_name"), VOCABULARY), ",").alias("tags"))


@query(f"""
WITH t AS (SELECT p_partkey, p_name, {_TAGS} AS g FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(g, lambda x: x IN ('colour', 'machine', 'size'))), ',') AS shared FROM t
WHERE regexp_matches(lower(p_name), 'gear|rod|red') AND len(list_filter(g, lambda x: x IN ('colour', 'machine'))) > 0
""")
def q09_tag_set_algebra(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", text.tags(F.col("p_name"), VOCABULARY).alias("g"))
    wanted = ["colour", "machine", "size"]
    kept = p.where(matching.relevant(F.col("p_name"), F.col("g"), wanted, ["gear", "rod", "red"], ["size"]))
    return kept.select("p_partkey", F.array_join(F.array_sort(F.array_intersect("g", F.array(*map(F.lit, wanted)))), ",").alias("shared"))


@query("""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 100 WHEN toxic = 1 THEN 45 END AS score FROM documents LEFT JOIN l USING (doc_id))
SELECT lang, CAST(round_even(avg(score), 0) AS BIGINT) AS score, coalesce(min(score) >= 80 AND count(score) = count(*), false) AS all_strong FROM s GROUP BY lang
""")
def q10_evidence_left_join(spark, d):
    labels = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = _t(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    match = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), matching.PRACTISED).when(F.col("toxic") == 1, matching.LEARNED).otherwise(matching.NO_INFO)
    return matching.overall(j.withColumn("score", matching.score(match)), "lang")


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END AS b, nullif(c_mktsegment, 'BUILDING') AS c
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CAST(round_even(100.0 * ((a <> 'unknown')::INT + (b <> ' ')::INT + (c IS NOT NULL)::INT) / 3, 0) AS BIGINT) AS completeness FROM x
""")
def q11_completeness(spark, d):
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "Unknown").otherwise(F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_orderstatus")).alias("b"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c"))
    return j.select("o_orderkey", matching.completeness(["a", "b", "c"]).alias("completeness"))


@query(f"""
WITH {_CANONICAL},
i AS (SELECT page_id, link, h, page_id AS k FROM canonical),
u AS (SELECT link, min(page_id) AS e FROM i WHERE page_id % 2 = 0 GROUP BY link), y AS (SELECT h, min(page_id) AS e FROM i WHERE page_id % 3 = 0 GROUP BY h)
SELECT page_id, coalesce(u.e, y.e, CASE WHEN page_id % 5 = 0 THEN page_id END) AS entity FROM i LEFT JOIN u USING (link) LEFT JOIN y USING (h)
""")
def q12_entity_resolution(spark, d):
    p = _t(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"), urls.host(F.col("url")).alias("identity"), F.col("page_id").cast("string").alias("content_hash"))
    first = lambda cond, key: p.where(cond).groupBy(key).agg(F.min("page_id").alias("entity"))
    return merge.resolve(p, first("page_id % 2 = 0", "url"), first("page_id % 3 = 0", "identity"), first("page_id % 5 = 0", "content_hash")).select("page_id", "entity")


@query(r"""
SELECT sha256(regexp_replace(lower(text), '\s', '', 'g')) AS content_hash, min(doc_id) AS owner, count(*) AS copies FROM documents GROUP BY 1
""")
def q13_exact_dup_groups(spark, d):
    keyed = _t(spark, d, "documents").select("doc_id", F.sha2(text.normal_form(F.col("text"), exact=False), 256).alias("content_hash"))
    return keyed.groupBy("content_hash").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))


@query(r"""
WITH x AS (SELECT sha256(regexp_replace(lower(text), '\s', '', 'g')) AS content_hash, doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, source FROM documents)
SELECT content_hash, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, arg_min(source, doc_id) AS source, greatest(count(DISTINCT lang) - 1, 0) AS lang_conflicts, greatest(count(DISTINCT source) - 1, 0) AS source_conflicts FROM x GROUP BY 1
""")
def q14_ordered_merge(spark, d):
    x = _t(spark, d, "documents").select(F.sha2(text.normal_form(F.col("text"), exact=False), 256).alias("content_hash"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), "source")
    return merge.first_known(x, "content_hash", "doc_id", ["lang", "source"])


@query("""
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, min(event_id) AS first_seq FROM events GROUP BY 1, 2
""")
def q15_latest_upsert(spark, d):
    return tables.latest_by_key(_t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'view' GROUP BY user_id")
def q16_fifo_queue(spark, d):
    return tasks.queue_head(_t(spark, d, "events").where("event_type <> 'view'").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 END IS DISTINCT FROM CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 END AS stale
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def q17_staleness(spark, d):
    version = lambda c: F.when(F.col(c) % 7 != 0, F.col(c) % 3).alias("version")
    made = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), version("o_orderkey"))
    now = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), version("c_custkey"))
    return tables.stale(made, now, "key", ["version"]).select("o_orderkey", "stale")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS recent FROM events
""")
def q18_rate_limit(spark, d):
    return windows.trailing_count(_utc(_t(spark, d, "events")), "user_id", "ts", 6 * 3600).select("event_id", "recent")


def _utc(events: DataFrame) -> DataFrame:
    """A time without zone is UTC, whatever the session's zone."""
    return events.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")))


@query("""
WITH e AS (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM events)
SELECT CAST(l AS DATE)::VARCHAR AS day, arg_min(event_id, l) AS event_id FROM e WHERE strftime(l, '%H:%M') >= '09:00' GROUP BY 1
""")
def q19_daily_trigger(spark, d):
    e = _t(spark, d, "events")
    hit = windows.first_of_day(e, dates.local_day(F.col("ts")), dates.clock(F.col("ts")), "09:00", "ts", ["event_id"])
    return hit.select(F.col("day").cast("string").alias("day"), "event_id")


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def q20_gaps(spark, d):
    return windows.gaps(_utc(_t(spark, d, "events")), "user_id", "ts", "event_id").select("event_id", "gap_us")


@query(f"""
WITH {_LINES}, m AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[TE]') THEN substr(line, 1, 1) WHEN regexp_matches(line, '^[AO]') THEN '' END AS marker FROM l),
s AS (SELECT doc_id, pos, marker, nullif(last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS section FROM m)
SELECT doc_id, section, count(*) AS n_lines FROM s WHERE section IS NOT NULL AND marker IS NULL GROUP BY 1, 2
""")
def q21_sections(spark, d):
    rows = windows.line_rows(_t(spark, d, "documents"), "doc_id", "text")
    marker = F.when(F.col("line").rlike("^[TE]"), F.substring("line", 1, 1)).when(F.col("line").rlike("^[AO]"), F.lit(""))
    s = windows.carry_sections(rows, "doc_id", marker)
    return s.where(F.col("section").isNotNull() & ~F.col("is_marker")).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, min(pos) AS i FROM l WHERE regexp_matches(line, '[0-9]') GROUP BY doc_id)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS frame FROM l JOIN h USING (doc_id) WHERE pos BETWEEN i - 2 AND i + 1 GROUP BY doc_id
""")
def q22_context_frame(spark, d):
    f = windows.context_frame(F.col("text"), lambda line: line.rlike("[0-9]"))
    return _t(spark, d, "documents").select("doc_id", F.array_join(f, "\n").alias("frame")).where("frame IS NOT NULL")


@query(r"""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, arg_max(text, turn) FILTER (role = 'user') AS a, arg_max(role, turn) AS last_role, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, user_turns, left(trim(a, ' '), 100) AS excerpt, last_role, array_to_string(t[greatest(len(t) - 11, 1) : len(t)], ',') AS last_turns,
  CASE WHEN NOT regexp_matches(coalesce(a, ''), '[0-9]') THEN 'evidence' WHEN NOT regexp_matches(a, '我|本人|负责|(^|[^\p{L}\p{N}_])(I|my)($|[^\p{L}\p{N}_])', 'i') THEN 'ownership' WHEN NOT regexp_matches(a, '对比|基线|baseline|对照|消融|ablation', 'i') THEN 'reliability' WHEN user_turns % 2 = 1 THEN 'failure analysis' ELSE 'transfer' END AS focus
FROM c
""")
def q23_conversation_state(spark, d):
    s = convo.states(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return s.withColumn("last_turns", F.array_join("last_turns", ","))


@query(r"""
WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?%?')) AS a FROM documents), b AS (SELECT string_agg(text, ' ' ORDER BY item_id) AS e FROM benchmark)
SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: NOT contains(e, x))), ',') AS unverified FROM n, b WHERE len(a) > 0
""")
def q24_number_provenance(spark, d):
    known = _t(spark, d, "benchmark").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), " ").alias("e"))
    doc = _t(spark, d, "documents").where(F.col("text").rlike(r"\d")).crossJoin(F.broadcast(known))  # one row of evidence
    return doc.select("doc_id", F.array_join(convo.unverified_numbers(F.col("text"), F.col("e")), ",").alias("unverified"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[\n。；;]+')) AS s, generate_subscripts(string_split_regex(text, '[\n。；;]+'), 1) AS pos FROM documents),
r AS (SELECT * FROM (VALUES ('quality', '(quality|the)'), ('team', '(of|und)'), ('place', '(de|la)')) t(role, p))
SELECT doc_id, role, trim(arg_min(s, pos), ' •-' || chr(9)) AS quote FROM s JOIN r ON regexp_matches(s, '(^|[^a-zA-Z])' || p || '($|[^a-zA-Z])', 'i') GROUP BY 1, 2
""")
def q25_role_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(matching.role_sentences(F.col("text"), ROLES)).alias("x")).select("doc_id", "x.role", "x.quote")


@query("""
SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rank FROM part QUALIFY rank <= 3
""")
def q26_topk_per_group(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.top_per_group(p, ["p_brand"], [F.desc("p_retailprice"), F.desc("p_partkey")], 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH x AS (SELECT p_brand, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 1 WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS hours, p_type IN ('PROMO', 'SMALL') AS helpful, substr(sha256(p_type || p_brand), 1, 16) AS item FROM part)
SELECT p_brand, count(DISTINCT item) AS items, CAST(coalesce(sum(hours) FILTER (NOT helpful), 0) AS BIGINT) AS interview_hours FROM x GROUP BY 1
""")
def q27_plan_hours(spark, d):
    p = _t(spark, d, "part")
    match = F.when(F.col("p_type") == "PROMO", matching.PRACTISED).when(F.col("p_size") % 2 == 0, matching.NO_INFO).otherwise(matching.LEARNED)
    items = plan.plan_items(p, "p_type", match, F.col("p_type") == "SMALL", F.col("p_brand"))
    total = plan.plan_total(items, "p_brand", 8.0).drop("estimated_weeks")
    return items.groupBy("p_brand").agg(F.count_distinct("item_id").alias("items")).join(total, "p_brand")


@query("""
WITH x AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE)::VARCHAR AS run, count(*) FILTER (event_type = 'error') AS failures, count(*) AS total FROM events GROUP BY 1)
SELECT run, failures, total, CASE WHEN failures > 0 AND failures < total THEN 'partial' WHEN failures > 0 THEN 'failed' ELSE 'completed' END AS status FROM x
""")
def q28_run_status(spark, d):
    e = _t(spark, d, "events").withColumn("run", dates.local_day(F.col("ts")).cast("string"))
    return tasks.run_summary(e, "run", F.col("event_type") == "error", F.col("event_type")).drop("error")


@query("""
WITH o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal AS state FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
SELECT n.c_custkey, n.c_name, n.seg, CASE WHEN o.c_custkey IS NOT NULL AND n.c_name IS NOT DISTINCT FROM o.c_name AND n.seg IS NOT DISTINCT FROM o.seg THEN o.state ELSE -1.0 END AS state FROM n LEFT JOIN o USING (c_custkey)
""")
def q29_settings_merge(spark, d):
    c = _t(spark, d, "customer")
    seg = lambda k: F.when(F.col("c_custkey") % k != 0, F.col("c_mktsegment")).alias("seg")
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", "c_name", seg(4), F.col("c_acctbal").alias("state"))
    return tables.merge_settings(c.select("c_custkey", "c_name", seg(8)), old, "c_custkey", ["c_name", "seg"], {"state": F.lit(-1.0)})


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1")
def q30_json_props(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).alias("k_sum"), F.count("*").alias("n"))


@query("""
SELECT 'nation:' || n_nationkey AS ref, n_name AS text, 'done' AS level FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name, 'background' FROM region UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'learned' FROM supplier
""")
def q31_union_bank(spark, d):
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("ref")
    n = _t(spark, d, "nation").select(ref("nation", "n_nationkey"), F.col("n_name").alias("text"), F.lit("done").alias("level"))
    r = _t(spark, d, "region").select(ref("region", "r_regionkey"), F.col("r_name").alias("text"), F.lit("background").alias("level"))
    return n.unionByName(r).unionByName(_t(spark, d, "supplier").select(ref("supplier", "s_suppkey"), F.lit("supplier").alias("text"), F.lit("learned").alias("level")))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier)
""")
def q32_anti_union(spark, d):
    others = [(_t(spark, d, "orders").where("o_orderstatus = 'O'"), "o_custkey"), (_t(spark, d, "events"), "user_id"), (_t(spark, d, "supplier"), "s_suppkey")]
    return tables.not_in_any(_t(spark, d, "customer"), "c_custkey", others).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)")
def q33_semi(spark, d):
    large = _t(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").join(large, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""
WITH e AS (SELECT c_custkey AS digest_id, unnest([c_custkey, c_custkey * 3, c_custkey * 17]) AS o_orderkey, unnest([0, 1, 2]) AS pos FROM customer)
SELECT digest_id, pos, o_orderkey, coalesce(o_orderpriority, 'gone') AS o_orderpriority FROM e LEFT JOIN orders USING (o_orderkey)
""")
def q34_explode_left(spark, d):
    digests = _t(spark, d, "customer").select(F.col("c_custkey").alias("digest_id"), F.array("c_custkey", F.col("c_custkey") * 3, F.col("c_custkey") * 17).alias("ids"))
    return ranking.show_digest(digests, _t(spark, d, "orders"), "ids", "o_orderkey", "o_orderpriority", "gone")


@query("""
WITH b AS (SELECT doc_id, list_concat([{'kind': 'title', 'text': source}, {'kind': 'meta', 'text': CASE WHEN lang = 'en' THEN '' ELSE lang END}], list_transform(string_split(text, chr(10)), lambda x: {'kind': 'line', 'text': x})) AS a FROM documents),
f AS (SELECT doc_id, list_filter(a, lambda x: trim(x.text, ' ') <> '') AS a FROM b)
SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a).kind AS kind, unnest(a).text AS text FROM f
""")
def q35_block_model(spark, d):
    lines = text.lines(F.col("text"))
    lines = F.when(F.col("text").endswith("\n"), F.concat(lines, F.array(F.lit("")))).otherwise(lines)
    blocks = plan.blocks([("title", F.array("source")), ("meta", F.array(F.when(F.col("lang") != "en", F.col("lang")))), ("line", lines)])
    return plan.block_rows(_t(spark, d, "documents"), "doc_id", blocks).withColumn("pos", F.col("pos").cast("bigint"))


@query("""
WITH x AS (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS b, c_nationkey AS m, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 7 END AS n FROM customer)
SELECT c_custkey, b AS c_mktsegment, n AS c_nationkey, array_to_string(list_filter([CASE WHEN a <> b THEN 'c_mktsegment:' || a || '>' || b END, CASE WHEN m <> n THEN 'c_nationkey:' || m || '>' || n END], lambda y: y IS NOT NULL), ',') AS changed FROM x
""")
def q36_patch_diff(spark, d):
    c = _t(spark, d, "customer")
    change = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "BUILDING").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 != 0, 7).alias("c_nationkey"))
    p = tables.patch(c, change, "c_custkey", ["c_mktsegment", "c_nationkey"])
    shown = F.array_join(F.transform(F.map_entries("changed"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["before"], F.lit(">"), e["value"]["after"])), ",")
    return p.withColumn("changed", shown)


@query()
def q37_html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query()
def q38_jsonld_udtf(spark, d):
    jsonld.register(spark)
    _t(spark, d, "pages").select("page_id", F.concat("html", F.lit('<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"title":"t'), F.col("page_id").cast("string"), F.lit('","hiringOrganization":{"name":"o"},"jobLocation":{"address":{"addressLocality":"深圳","addressCountry":"中国"}},"validThrough":"2020-01-01"}]}</script>')).alias("html")).createOrReplaceTempView("_pages_with_postings")
    return spark.sql("SELECT page_id, j.* FROM _pages_with_postings, LATERAL job_postings(html, '2026-01-01T00:00:00+00:00') j")


_ROBOTS = [("com", "User-agent: *\nDisallow: /*?*\nDisallow: /en/1*\nAllow: /en/12$\nCrawl-delay: 2"), ("net", "User-agent: *\nDisallow: /\nUser-agent: collector\nAllow: /\nDisallow: /de/"), ("org", "# nothing\nUser-agent: other\nDisallow: /")]


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '\.([a-z]+)(?:[/?#]|$)', 1) AS origin, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q, contains(url, '?') AS hasq FROM pages)
SELECT page_id, CASE WHEN origin = 'com' THEN CASE WHEN path = '/en/12' AND NOT hasq THEN true WHEN starts_with(path, '/en/1') OR (hasq AND q <> '') THEN false ELSE true END
  WHEN origin = 'net' THEN NOT starts_with(path, '/de/') ELSE true END AS allowed FROM p
""")
def q39_robots(spark, d):
    files = spark.createDataFrame(_ROBOTS, "origin string, text string")
    held = robots.rules(files, "origin", "text", "collector/1.0")
    p = _t(spark, d, "pages").select("page_id", "url", F.substring_index(urls.host(F.col("url")), ".", -1).alias("tld"))
    return robots.allowed(p, "url", "tld", held).select("page_id", "allowed")


@query(r"""
SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' WHEN regexp_matches(url, '^https://([^/?#]*\.)?casino-win\.example\.org([/?#]|$)') THEN 'restricted' ELSE 'ok' END AS reason FROM pages
""")
def q40_url_admission(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.admission(F.col("url"), ["casino-win.example.org"]).alias("reason"))


@query("""
SELECT DISTINCT CAST(ts + INTERVAL 8 HOUR AS DATE)::VARCHAR AS day FROM events WHERE strftime(ts + INTERVAL 8 HOUR, '%H:%M') >= '09:00'
""")
def q41_stream_daily_marks(spark, d):
    marks = streams.daily_marks(streams.stream_table(spark, d, "events"), "ts", "09:00")
    return streams.run_once(marks, _scratch(spark), "days").select(F.col("day").cast("string").alias("day"))


@query()
def q42_stream_rate_state(spark, d):
    e = streams.stream_table(spark, d, "events")
    attempts = _utc(e).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros("ts").alias("us"), (F.col("event_type") == "purchase").alias("success"))
    return streams.run_once(streams.rate_limit(attempts, 3, 6 * 3600), _scratch(spark), "limits")


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000
""")
def q43_stream_ledger(spark, d):
    where = _scratch(spark)
    stream = streams.stream_table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_orderkey").alias("id"))
    for _ in range(2):  # a second run finds nothing new
        streams.deliver(stream, where, lambda df, ledger: df.join(ledger, "id", "left_anti"))
    return spark.read.schema("id bigint").parquet(f"{where}/ledger").select("id")


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type IN ('view', 'signup') THEN 'failed' WHEN event_type = 'purchase' THEN 'uncertain' ELSE 'completed' END AS status FROM events
""")
def q44_recovery(spark, d):
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "task").when(F.col("event_type").isin("view", "signup"), "run").otherwise("digest")
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "sending").otherwise("completed")
    return e.select("event_id", tasks.recovered(kind, status).alias("status"))


@query("""
SELECT doc_id, count(*) FILTER (quality = 1) AS n_quality, count(*) AS n FROM labels GROUP BY doc_id
""")
def q45_update_or_append(spark, d):
    one = _t(spark, d, "labels").groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("n_quality"), F.count("*").alias("n"))
    return tables.update_or_append(one.where("doc_id % 2 = 0"), one.where("doc_id % 2 = 1 OR doc_id % 4 = 0"), "doc_id")


@query("""
SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events
""")
def q46_version_chain(spark, d):
    return windows.version_chain(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").drop("event_type")


@query(r"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, left(text, 200) AS answer_excerpt, regexp_matches(text, '[0-9]|验证|评估|实验|baseline|evaluat|test', 'i') AS has_evidence,
  regexp_matches(text, '我|本人|负责|(^|[^\p{L}\p{N}_])(I|my)($|[^\p{L}\p{N}_])', 'i') AS has_ownership, regexp_matches(text, '首先|目标|结果|问题|because|result|goal|first', 'i') AS has_structure FROM u
""")
def q47_conversation_review(spark, d):
    return convo.review(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text").withColumn("round", F.col("round").cast("bigint"))


@query()
def q48_ordered_ingest(spark, d):
    doc = _t(spark, d, "documents")
    blank = {f: F.lit("") for f in matching.FACTS} | {"title": F.col("source"), "city": F.col("lang")}
    rows = doc.select(F.col("doc_id").alias("seq"), F.array(F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 20)).cast("string"))).alias("urls"), F.lit("").alias("identity"), F.sha2(text.normal_form(F.col("text"), exact=False), 256).alias("content_hash"), F.lit("source_refresh").alias("mode"), F.array().cast("array<string>").alias("edited"), F.col("text").alias("raw_text"), F.lit("未知").alias("status_validity"), *[c.alias(n) for n, c in blank.items()])
    return merge.ingest(rows).select("entity", "seqs", "urls", F.size("conflicts").alias("n_conflicts"), "title", "city", F.sha2("raw_text", 256).alias("raw_text_hash"))


@query("""
SELECT o_orderkey, 'C' || o_custkey AS company, o_orderpriority AS title, 'duty ' || o_orderkey || chr(10) || 'more' AS responsibilities, 'need ' || o_custkey AS requirements,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 5 END::BIGINT AS n_uncertain FROM orders
""")
def q49_parse_postings(spark, d):
    o = _t(spark, d, "orders")
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy年M月d日")
    posting = F.concat(F.lit("公司名称： C"), who, F.lit("\n岗位:"), F.col("o_orderpriority"), F.lit("\n职责：duty "), key, F.lit("\nmore\n\nMORE\n任职要求\nneed "), who, F.lit("\n福利：none\nafter\n"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("发布时间："), day)).otherwise("发布时间：1999-99-99"))
    parsed = parsing.parse_postings(o.select("o_orderkey", posting.alias("t")), "o_orderkey", "t")
    return parsed.select("o_orderkey", "company", "title", "responsibilities", "requirements", "published_at", F.size("uncertain_fields").cast("bigint").alias("n_uncertain"))
