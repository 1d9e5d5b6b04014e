"""Queries over keyed records, listings and plans, registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing, matching, plan, tables, tasks
from .queries import _t, query


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def q50_insert_or_ignore(spark, d):
    return tables.insert_or_ignore(_t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("seq")), "o_custkey", "o_orderkey", "seq")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q51_delete_where(spark, d):
    gone = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.delete_where(_t(spark, d, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("SELECT coalesce(max(c_name) FILTER (c_custkey = 7), '') AS \"value\" FROM customer")
def q52_value_or_default(spark, d):
    kv = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return tables.get(kv, "7", F.lit(""))


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS p, list_sort(list_distinct(list(l_suppkey))) AS s, count(*) = count(DISTINCT l_partkey) AS all_differ FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_concat(p, list_filter(s, lambda x: NOT list_contains(p, x))), ',') AS refs, all_differ FROM a
""")
def q53_append_absent(spark, d):
    a = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"), F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.collect_list("l_partkey").alias("each"))
    return a.select("l_orderkey", F.array_join(tables.append_absent(F.col("p"), F.col("s")).cast("array<string>"), ",").alias("refs"), tables.unique(F.col("each")).alias("all_differ"))


@query("""
SELECT p_partkey, list_extract(list_sort(list_transform(string_split(p_name, ' '), lambda x, i: {'n': CASE WHEN x IN ('red', 'hot', 'old', 'large') THEN -1 ELSE 0 END, 'i': i, 'x': x})), 1).x AS first_word FROM part
""")
def q54_by_overlap(spark, d):
    wanted = F.array(*map(F.lit, ("red", "hot", "old", "large")))
    ordered = matching.by_overlap(F.split("p_name", " "), wanted, lambda x: F.array(x))
    return _t(spark, d, "part").select("p_partkey", F.element_at(ordered, 1).alias("first_word"))


@query("""
SELECT p_partkey, array_to_string(list_concat(list_filter(string_split(p_name, ' '), lambda x: len(x) > 4), list_filter(string_split(p_name, ' '), lambda x: len(x) <= 4)), ' ') AS words,
  list_sort(string_split(p_name, ' ')) = list_sort(string_split(lower(p_name), ' ')) AS same FROM part
""")
def q55_relevant_first(spark, d):
    words = F.split("p_name", " ")
    return _t(spark, d, "part").select("p_partkey", F.array_join(plan.relevant_first(words, lambda x: F.length(x) > 4), " ").alias("words"), matching.same_numbers(words, F.split(F.lower("p_name"), " ")).alias("same"))


@query("""
SELECT o_orderkey, o_orderpriority <> '' AND contains(o_orderpriority, 'URGENT') AND list_bool_and([c_acctbal > 0]) AS holds FROM orders JOIN customer ON o_custkey = c_custkey
""")
def q56_supported(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bank = F.create_map(F.col("c_custkey"), F.col("c_acctbal") > 0)
    return o.select("o_orderkey", ((F.col("o_orderpriority") != "") & matching.supported(F.lit("URGENT"), F.col("o_orderpriority"), F.array("c_custkey"), bank)).alias("holds"))


@query("""
SELECT n_nationkey, n_name, c.n AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY 1) c ON n_nationkey = c_nationkey
""")
def q57_task_grid(spark, d):
    few = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return tasks.task_grid(_t(spark, d, "nation").select("n_nationkey", "n_name"), few, "n_nationkey")


@query("SELECT o_orderkey AS seq, 'running' AS status, 1 + o_custkey % 3 AS attempts FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def q58_claim(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed")
    return tasks.claim(_t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), status.alias("status"), (F.col("o_custkey") % 3).alias("attempts")))


@query("SELECT o_orderkey AS seq, 'running' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 1")
def q59_active_run(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return tasks.active_run(_t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), status.alias("status")))


@query("SELECT c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 1")
def q60_owner_of(spark, d):
    o, c = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_custkey").alias("owner")), _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return listing.owner_of(o, c, 1, key="c_custkey")


@query("""
SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) = len(string_split(p_type, ' ')) THEN len(string_split(p_name, ' ')) END AS pairs FROM part
""")
def q61_aligned(spark, d):
    both = listing.aligned(F.split("p_name", " "), F.split("p_type", " "))
    return _t(spark, d, "part").select("p_partkey", F.when(both.isNotNull(), F.size(both)).cast("bigint").alias("pairs"))


@query("""
SELECT p_partkey, coalesce(list_extract(list_filter(string_split(p_name, ' '), lambda x: len(x) = 3), 1), list_extract(string_split(p_name, ' '), 1), 'none') AS chosen FROM part
""")
def q62_first_eligible(spark, d):
    return _t(spark, d, "part").select("p_partkey", listing.first_eligible(F.split("p_name", " "), lambda x: F.length(x) == 3, F.lit("none")).alias("chosen"))


@query("""
SELECT c_custkey, coalesce(c_acctbal > 0, FALSE) AND coalesce(c_mktsegment = 'BUILDING', FALSE) AND contains(c_name, 'Customer') AS untouched FROM customer
""")
def q63_untouched(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", listing.untouched([F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING"], F.array("c_name"), "Customer").alias("untouched"))


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 2000 THEN 'text' END, CASE WHEN length(source) > 5 THEN 'links' END) AS exceeded FROM documents
""")
def q64_within_limits(spark, d):
    limits = listing.within_limits({"text": F.length("text"), "links": F.length("source")}, {"text": 2000, "links": 5})
    return _t(spark, d, "documents").select("doc_id", F.array_join(limits, ",").alias("exceeded"))


@query("SELECT event_id, coalesce(ts > TIMESTAMP '2024-01-15', FALSE) AS alive FROM events")
def q65_alive(spark, d):
    return _t(spark, d, "events").select("event_id", listing.alive(F.col("ts"), F.lit("2024-01-15").cast("timestamp")).alias("alive"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' END AS day FROM orders
""")
def q66_iso_date(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(day, F.lit("T10:00:00Z"))).when(k == 1, day).when(k == 2, "unknown").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return _t(spark, d, "orders").select("o_orderkey", listing.iso_date(text, "unknown").alias("day"))


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN (CASE WHEN s_acctbal < 0 THEN 'sample:' ELSE '' END) || sha256(lower(trim(s_name)) || '|' || s_nationkey::VARCHAR) END AS identity FROM supplier
""")
def q67_identity(spark, d):
    s = _t(spark, d, "supplier")
    nation = F.when(F.col("s_nationkey") % 5 == 0, "open").otherwise(F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", listing.identity([F.col("s_name"), nation], ["open"], F.col("s_acctbal") < 0).alias("identity"))


@query("""
SELECT o_orderkey AS seq, o_orderpriority AS published, nullif(o_custkey % 7, 3) AS score FROM orders
ORDER BY o_orderstatus = 'O' DESC, o_totalprice > 100000 DESC, coalesce(o_orderpriority, '') DESC, CASE WHEN coalesce(nullif(o_custkey % 7, 3), 0) = 0 THEN -1 ELSE o_custkey % 7 END DESC, o_orderkey DESC LIMIT 20
""")
def q68_recommended_order(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "O").alias("city"), (F.col("o_totalprice") > 100000).alias("confirmed"), F.col("o_orderpriority").alias("published"), F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("score"))
    return o.orderBy(*listing.recommended_order("city", "confirmed", "published", "score", "seq")).limit(20).select("seq", "published", "score")


@query("""
SELECT count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'none') AS "none" FROM orders
""")
def q69_group_counts(spark, d):
    return listing.group_counts(_t(spark, d, "orders"), "o_orderstatus", ["O", "F", "none"])


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS completed, 5 AS steps, round_even(count(*) FILTER (o_orderstatus = 'F') * 100.0 / 5, 1)::DOUBLE AS percent FROM orders GROUP BY o_custkey
""")
def q70_progress(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    done = listing.progress(_t(spark, d, "orders").withColumn("status", status), "o_custkey", "status", 5)
    return done.withColumn("percent", F.col("percent").cast("double"))


@query("""
SELECT c_custkey, c_nationkey, '{"c_name":' || to_json(c_name) || ',"c_mktsegment":' || to_json(c_mktsegment) || '}' AS snapshot FROM customer
""")
def q71_audit_rows(spark, d):
    return listing.audit_rows(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"), "c_custkey", "c_nationkey")


@query("""
SELECT o_orderkey, o_orderpriority, coalesce(s.score, CAST(o_custkey % 11 AS BIGINT)) AS score FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber)::BIGINT AS score FROM lineitem GROUP BY 1 HAVING count(*) > 4) s ON o_orderkey = l_orderkey
""")
def q72_decorate(spark, d):
    stored = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("bigint").alias("score"), F.count("*").alias("n")).where("n > 4")
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return listing.decorate(rows, stored, "o_orderkey", {"score": F.col("o_custkey") % 11}, ["o_custkey"])
