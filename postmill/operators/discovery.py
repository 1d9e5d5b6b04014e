"""A discovery run: what enabled sources gave, what of it is relevant, new or merged, and the shortlist of what wasn't told before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..storage import materialize
from ..streaming.entities import ROW, Entities
from ..streaming.publication import Publication
from .tasks import run_status

RESULT = "source string, status string, error string, fetched bigint, relevant bigint, new bigint, merged bigint"
LEDGER, DIGEST = "id bigint", "id bigint, place bigint"
_ROW = [c.split()[0] for c in ROW.split(", ")]


def discover(fetched: DataFrame, failures: DataFrame, sources: DataFrame, relevant: Column, store: Entities, number: int) -> DataFrame:
    """Fold the relevant postings of the enabled sources into the entities as batch `number`; a row of RESULT for each enabled source.

    fetched: the columns of a posting (ROW) and source. failures (source, error): a failed source is a row, keeps what it gave before, and
    fails nothing else. Sources are a catalog (name, enabled): few. Their counters are observed while the postings
    are written, not in passes of their own."""
    names = [r["name"] for r in sources.where("enabled").select("name").distinct().orderBy("name").collect()]
    if not names:
        return sources.sparkSession.createDataFrame([], RESULT)
    failed = failures.where(F.col("source").isin(names)).groupBy("source").agg(F.min("error").alias("error"))
    seen, kept = Observation("fetched"), Observation("relevant")
    count = lambda i, n: F.count_if(F.col("source") == n).alias(f"n{i}")
    rows = fetched.where(F.col("source").isin(names)).join(F.broadcast(failed.select("source")), "source", "left_anti")
    rows = rows.observe(seen, *[count(i, n) for i, n in enumerate(names)]).where(relevant).observe(kept, *[count(i, n) for i, n in enumerate(names)])
    rows = materialize(rows.select("source", *_ROW), "discovered")
    store.ingest(rows.select(*_ROW), number)
    entity = store.store.read("entities", "entity bigint, seqs array<bigint>").where(F.col("batch") == number)
    made = rows.select("source", "seq").join(entity.select(F.col("entity").alias("seq")), "seq", "left_semi").groupBy("source").agg(F.count("*").alias("new"))
    told = sources.sparkSession.createDataFrame([(n, seen.get[f"n{i}"], kept.get[f"n{i}"]) for i, n in enumerate(names)], "source string, fetched bigint, relevant bigint")
    out = told.join(made, "source", "left").join(failed, "source", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    return out.select("source", status.alias("status"), "error", "fetched", "relevant", F.col("new").cast("bigint").alias("new"), (F.col("relevant") - F.col("new")).cast("bigint").alias("merged"))


def run_row(results: DataFrame, recommended: DataFrame) -> DataFrame:
    """The run in one row: status, the sums of its sources, how many are recommended, and the errors in the sources' order."""
    failed = F.count_if(F.col("status") == "failed")
    errors = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.concat("source", F.lit("："), "error"))))
    sums = results.agg(run_status(failed, F.count("*")).alias("status"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "new", "merged")], F.array_join(errors, "；").alias("error"))
    return sums.join(F.broadcast(recommended.agg(F.count("*").alias("recommended"))))


def publish_digest(candidates: DataFrame, ranking: list[Column], where: str, number: int, spark, k: int = 12) -> DataFrame:
    """Tell the k best candidates (id) that no earlier digest told: ledger and digest are published together, under the batch's number.

    The same number again replaces both, so a run that is repeated after a crash tells the same; a crash between the two
    shows neither. Returns the digest."""
    store = Publication(spark, where)
    told = store.read("ledger", LEDGER, before=number).select("id")
    best = candidates.join(told, "id", "left_anti").orderBy(*ranking).limit(k)  # so few that one window can number them
    placed = best.select("id", (F.row_number().over(Window.orderBy(*ranking)) - 1).cast("bigint").alias("place"))
    placed = materialize(placed, "digest")
    store.write(number, {"ledger": placed.select("id"), "digest": placed})
    return placed
