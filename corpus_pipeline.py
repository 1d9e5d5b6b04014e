"""A corpus pipeline over `documents`: toxicity, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the docs of the next; all but the last return the columns of documents. A stage works on every row that
the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import materialize, table
from postmill.llm.decontaminate import drop_contaminated
from postmill.llm.exact_dedup import drop_duplicates
from postmill.llm.packing import pack_documents
from postmill.llm.simhash import drop_near_duplicates
from postmill.llm.toxicity import drop_toxic

#: Rows of a batch that executors hand to Python workers, at most: whole texts are long, and both sides hold a batch.
BATCH_ROWS = 500


def _batched(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _batched(lambda spark, docs, sf_dir: drop_toxic(docs, table(spark, sf_dir, "labels")))),
    ("exact dedup", _batched(lambda spark, docs, sf_dir: drop_duplicates(docs))),
    ("near dedup", _batched(lambda spark, docs, sf_dir: drop_near_duplicates(docs))),
    ("decontamination", _batched(lambda spark, docs, sf_dir: drop_contaminated(docs, table(spark, sf_dir, "benchmark")))),
    ("packing", _batched(lambda spark, docs, sf_dir: pack_documents(docs, release=True))),
]

#: No stage after the fitted classifier can be told by SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
