"""Audit of filters that act together, by a Walsh-Hadamard transform.

Each document is one mask of the filters that it fails. For each part and label the sums over the documents of
(-1)**|mask & S|, one for each set S of filters, are taken in one aggregation; the inverse transform gives the exact
number of documents of each mask. All that is asked about orders of filters follows from these few cells: what
each step removes, what it would have removed alone, and the Shapley share, of which a document that fails k
filters gives each of them the same part of all orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, UPPER, free_name, materialize, small, table

#: Groups of equal texts that are broadcast, at most (under 100 bytes each); beyond, they are joined by shuffling.
BROADCAST_GROUPS = 1_000_000
#: Filters of one audit, at most: 2**n sums are taken and n! orders are told.
MOST_FILTERS = 6
_BLANK = r"[\x20\x09-\x0D]+"


def _parity(of: Column) -> Column:
    """1 for an even number of set bits, -1 for an odd one."""
    return (1 - 2 * (F.bit_count(of) % 2)).cast("bigint")


def signed_sums(masks: DataFrame, by: list[str], n: int, mask: str = "mask") -> DataFrame:
    """by and sums, the 2**n signed parity sums of the masks of each group."""
    each = [F.sum(_parity(F.col(mask).bitwiseAND(F.lit(s)))).alias(f"w{s}") for s in range(1 << n)]
    return masks.groupBy(*by).agg(*each).select(*by, F.array(*[f"w{s}" for s in range(1 << n)]).alias("sums"))


def cells(sums: Column, n: int) -> Column:
    """The number of documents of each mask: the inverse transform, exact in integers."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    one = lambda m: F.aggregate(sets, F.lit(0).cast("bigint"), lambda total, s: total + F.get(sums, s) * _parity(m.bitwiseAND(s)))
    return F.transform(sets, lambda m: F.shiftright(one(m), n))  # 2**n times the number


def order_audit(counted: DataFrame, part: str, letters: list[str], labels: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, {label}_lost and shapley.

    counted: part, and the documents of each mask as the arrays `all` and one for each label. What no filter of a set
    removes is summed once a part and set; the rows of the orders only look it up."""
    n = len(letters)
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    total = lambda of, weight: F.aggregate(sets, F.lit(0).cast("bigint"), lambda t, m: t + F.get(F.col(of), m) * weight(m).cast("bigint"))
    clear = lambda of: F.transform(sets, lambda s: total(of, lambda m: m.bitwiseAND(s) == 0)).alias(f"clear_{of}")
    share = lambda i: total("all", lambda m: F.when(m.bitwiseAND(F.lit(1 << i)) != 0, F.floor(F.lit(factorial(n)) / F.bit_count(m))).otherwise(0))
    once = counted.select(part, "all", *[clear(x) for x in ["all", *labels]], F.array(*[share(i) for i in range(n)]).alias("shares"))
    stepped = once.select("*", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit_of = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    before = F.aggregate(F.slice(F.split("filter_order", ""), 1, F.col("step") - 1), F.lit(0), lambda m, c: m + F.element_at(bit_of, c))
    at = stepped.withColumn("mine", F.element_at(bit_of, F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))).withColumn("earlier", before).withColumn("both", F.col("mine") + F.col("earlier"))
    lost = lambda of: F.get(f"clear_{of}", F.col("earlier")) - F.get(f"clear_{of}", F.col("both"))
    failing = F.get("clear_all", F.lit(0)) - F.get("clear_all", F.col("mine"))
    return at.select(
        part, "filter_order", "step", F.get("clear_all", F.col("both")).alias("kept"), lost("all").alias("removed"), (failing - lost("all")).alias("redundant"), F.get("all", F.col("mine")).alias("unique_fails"),
        *[lost(x).alias(f"{x}_lost") for x in labels], F.get("shares", F.log2(F.col("mine")).cast("int")).alias("shapley"),
    )


def audit(masks: DataFrame, part: str, letters: list[str], labels: list[str], mask: str = "mask") -> DataFrame:
    """The audit of all orders of the filters, by part.

    masks: a row for each document with its part, its labels (booleans, null: no) and the bits of the filters that it
    fails, the first letter being bit 0. Parts that no document has give no row. Only one row for each part and
    combination of labels leaves the aggregation, however skewed the parts are."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    n = len(letters)
    flags = [F.coalesce(F.col(x), F.lit(False)).alias(x) for x in labels]
    counted = signed_sums(masks.select(F.col(part).alias("part"), F.col(mask).alias("mask"), *flags), ["part", *labels], n)
    rows = counted.select("part", *labels, cells(F.col("sums"), n).alias("cells")).groupBy("part").agg(F.collect_list(F.struct("cells", *labels)).alias("rows"))  # 2**labels rows a part
    none = F.array_repeat(F.lit(0).cast("bigint"), 1 << n)
    added = lambda rows: F.aggregate(rows, none, lambda t, r: F.zip_with(t, r["cells"], lambda x, y: x + y))
    arrays = rows.select(F.col("part").alias(part), added(F.col("rows")).alias("all"), *[added(F.expr(f"filter(rows, r -> r.`{x}`)")).alias(x) for x in labels])
    return order_audit(arrays, part, letters, labels)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: under 50 words, under 65 of 100 words distinct, over 5 of 100 characters A-Z, marks of code."""
    words = F.array_remove(F.split(text, _BLANK, -1), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": F.coalesce(text.rlike("[#$%&*|]"), F.lit(False))}


def failure_masks(docs: DataFrame, filters=text_filters, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, mask, *keep) of each row: the bits of the filters that its text fails, and as the last bit whether a row with a smaller id has the same text.

    A null text counts as empty. A null id has no smaller one and is none; rows that repeat an id and a text don't fail for
    each other. Texts are compared by their SHA-256; digests, not texts, are shuffled, and of a large group of copies only
    the digest's smallest id leaves each partition."""
    name = free_name(docs, "audited")
    failed = filters(F.col(name))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(name))
    rows = materialize(rows.select("id", mask.alias("mask"), F.unhex(F.sha2(name, 256)).alias("sha"), *keep), "audit-rows")
    firsts = materialize(rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "audit-firsts")
    joined = rows.join(small(firsts, firsts.count(), BROADCAST_GROUPS), "sha", "left")
    return joined.select("id", (F.col("mask") + F.when(F.col("first") < F.col("id"), 1 << len(failed)).otherwise(0)).alias("mask"), *keep)


def filter_audit(docs: DataFrame, labels: DataFrame, filters=text_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """All orders of the text filters (letters A, B, ...) and of the filter of repeated texts (the next letter), by part.

    labels: doc_id, quality and toxic; a document is good or toxic if any of its label rows says 1, one without rows is
    neither. A null part counts as the empty string. An empty docs gives an empty result."""
    letters = [chr(65 + i) for i in range(len(filters(F.lit(""))) + 1)]
    masks = failure_masks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")), filters, keep=["part"])
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return audit(masks.join(told, "id", "left"), "part", letters, ["good", "toxic"])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all of documents, by source: 120 orders of 5 steps each."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, filter_order[step:step] AS mine, filter_order[1:step - 1] AS earlier FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)
), r AS (
  SELECT part, filter_order, step, any_value(mine) AS mine,
    sum(CASE WHEN translate(fails, earlier || mine, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, mine) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, mine) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = mine THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, mine) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, mine) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley
FROM r
"""
