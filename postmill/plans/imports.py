"""Queries over paged sources, imports and discovery, registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import discovery, imports, matching
from ..sources import paged
from ..streaming import entities
from .queries import _scratch, _t, query

PAGE = 5_000
LIMITS = {"text": 4_000, "urls": 200, "links": 2, "files": 3, "images": 1, "bytes": 9_000}


@query(f"SELECT page_id, url, ((row_number() OVER (ORDER BY page_id) - 1) // {PAGE} * {PAGE})::BIGINT AS skip FROM pages")
def q83_paged_source(spark, d):
    rows = paged.read_pages(spark, "parquet", limit=PAGE, pages=None, path=f"{d}/pages.parquet", columns="page_id,url")
    return rows.select(F.from_json("payload", "page_id bigint, url string").alias("x"), "skip").select("x.*", "skip")


def _parts(spark, d):
    """documents as parts of imports, eight an import: texts, files and links, some of which gave nothing."""
    i, kind = F.col("doc_id"), F.col("doc_id") % 4
    name = F.when(kind == 2, F.concat(F.lit("f"), i.cast("string"), F.when(i % 3 == 0, ".png").otherwise(".txt"))).when(kind == 3, F.when(i % 11 == 0, F.lit("no link")).otherwise(F.concat(F.lit("https://x.example/"), i.cast("string"))))
    return _t(spark, d, "documents").select(F.floor(i / 8).alias("import"), i.alias("pos"), F.when(kind < 2, "text").when(kind == 2, "file").otherwise("link").alias("kind"), name.alias("name"), F.length("text").cast("bigint").alias("size"), "text", F.when((i % 10 == 7) & (kind >= 2), "gone").alias("error"))


@query(f"""
WITH p AS (SELECT doc_id // 8 AS import, doc_id AS pos, doc_id % 4 AS k, text, length(text) AS size, doc_id % 4 = 2 AND doc_id % 3 = 0 AS image, doc_id % 4 = 3 AND doc_id % 11 = 0 AS bad, doc_id % 10 = 7 AND doc_id % 4 >= 2 AS failed FROM documents),
s AS (SELECT import, sum(CASE WHEN k < 2 THEN size ELSE 0 END) AS text, sum(CASE WHEN k = 3 THEN size + 1 ELSE 0 END) AS urls, count(*) FILTER (k = 2) AS files, count(*) FILTER (image) AS images, count(*) FILTER (k = 3) AS links, sum(CASE WHEN k = 2 THEN size ELSE 0 END) AS bytes,
  count(*) FILTER (bad OR failed) AS n_warnings, count(*) FILTER (k = 3 AND NOT bad) AS n_sources, count(*) FILTER (k = 2) AS n_attachments FROM p GROUP BY 1),
o AS (SELECT *, CASE WHEN text > {LIMITS['text']} THEN 'text' WHEN urls > {LIMITS['urls']} THEN 'urls' WHEN files > {LIMITS['files']} THEN 'files' WHEN images > {LIMITS['images']} THEN 'images' WHEN links > {LIMITS['links']} THEN 'links' WHEN bytes > {LIMITS['bytes']} THEN 'bytes' END AS over FROM s),
l AS (SELECT import, pos, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p WHERE NOT bad AND NOT failed),
f AS (SELECT import, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '', '') AS line, pos, i, row_number() OVER (PARTITION BY import, lower(regexp_replace(line, '\\s+', '', 'g')) ORDER BY pos, i) AS n FROM l WHERE regexp_replace(line, '\\s+', '', 'g') <> ''),
m AS (SELECT import, string_agg(line, chr(10) ORDER BY pos, i) AS merged FROM f WHERE n = 1 GROUP BY import)
SELECT import, over, CASE WHEN over IS NULL THEN sha256(coalesce(merged, '')) END AS text_hash, CASE WHEN over IS NULL THEN n_warnings END AS n_warnings, CASE WHEN over IS NULL THEN n_sources END AS n_sources, CASE WHEN over IS NULL THEN n_attachments END AS n_attachments FROM o LEFT JOIN m USING (import)
""")
def q84_import_parts(spark, d):
    got = imports.import_parts(_parts(spark, d), limits=LIMITS)
    n = lambda c: F.size(c).cast("bigint")
    when = lambda x: F.when(F.col("over").isNull(), x)
    return got.select("import", "over", F.sha2("raw_text", 256).alias("text_hash"), when(n("warnings")).alias("n_warnings"), when(n("sources")).alias("n_sources"), when(n("attachments")).alias("n_attachments"))


_FETCHED = """
e AS (SELECT doc_id, source, text, CAST(substr(source, 4) AS INT) AS s FROM documents WHERE CAST(substr(source, 4) AS INT) % 7 <> 3),
k AS (SELECT *, regexp_matches(text, '(^|[^a-zA-Z])(the|that|this)($|[^a-zA-Z])', 'i') AS relevant FROM e WHERE s % 10 <> 5),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '\\s', '', 'g')) ORDER BY doc_id) = 1 AS new FROM k WHERE relevant)
"""


def _discovered(spark, d):
    """documents as what sources gave: some sources are off, some fail. Two runs of it; the results of the first and the second."""
    doc, number = _t(spark, d, "documents"), F.substring("source", 4, 9).cast("int")
    blank = {f: F.lit("") for f in matching.FACTS}
    none = F.array().cast("array<string>")
    rows = doc.select(F.col("doc_id").alias("seq"), F.lit(False).alias("sample"), none.alias("urls"), F.lit("source_refresh").alias("mode"), none.alias("edited"), F.col("text").alias("raw_text"), F.lit("有效").alias("status_validity"), *[c.alias(f) for f, c in blank.items()], "source")
    names = doc.select(F.col("source").alias("name"), number.alias("n")).distinct()
    failures = names.where("n % 10 = 5").select(F.col("name").alias("source"), F.lit("HTTP 503").alias("error"))
    store = entities.Entities(spark, f"{_scratch(spark)}/discovery")
    wanted = text.mentions_any(F.col("raw_text"), ["the", "that", "this"])
    return store, [discovery.discover(rows.withColumn("seq", F.col("seq") + again * 10**12), failures, names.select("name", (F.col("n") % 7 != 3).alias("enabled")), wanted, store, again) for again in (0, 1)]


@query(f"""
WITH {_FETCHED}, c AS (SELECT source, any_value(s) AS s FROM e GROUP BY source),
f AS (SELECT source, count(*) AS fetched, count(*) FILTER (relevant) AS relevant FROM k GROUP BY source), w AS (SELECT source, count(*) FILTER (new) AS new FROM n GROUP BY source),
r AS (SELECT source, s, coalesce(fetched, 0) AS fetched, coalesce(relevant, 0) AS relevant, coalesce(new, 0) AS new FROM c LEFT JOIN f USING (source) LEFT JOIN w USING (source))
SELECT run, source, CASE WHEN s % 10 = 5 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN s % 10 = 5 THEN 'HTTP 503' END AS error, fetched, relevant, CASE WHEN run = 0 THEN new ELSE 0 END AS new, CASE WHEN run = 0 THEN relevant - new ELSE relevant END AS merged
FROM r, (VALUES (0), (1)) t(run)
""")
def q85_discovery(spark, d):
    _, runs = _discovered(spark, d)
    return runs[0].withColumn("run", F.lit(0)).unionByName(runs[1].withColumn("run", F.lit(1)))


@query("""
WITH c AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT (n - 1) // 12 AS batch, id, (n - 1) % 12 AS place FROM c WHERE n <= 36
""")
def q86_digest_publication(spark, d):
    """Three digests, the second written twice: none tells what an earlier one told, a repeated one tells the same."""
    where = f"{_scratch(spark)}/digests"
    open_ = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    for number in (0, 1, 1, 2):
        discovery.publish_digest(open_, [F.desc("o_totalprice"), F.col("id")], where, number, spark)
    return discovery.Publication(spark, where).read("digest", discovery.DIGEST)
