"""Tasks and runs: queue heads, recovery, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of tasks in order, and states (fixed values).
STATES = ["queued", "running", "completed", "blocked", "failed"]


def queue_head(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The oldest row of each queue."""
    rest = [c for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(F.min(F.struct(seq, *rest)).alias("x")).select(key, "x.*")


def claim(df: DataFrame, status: str = "status", seq: str = "seq", attempts: str = "attempts") -> DataFrame:
    """The oldest queued task, running and with one more attempt."""
    return df.where(F.col(status) == "queued").orderBy(seq).limit(1).withColumns({status: F.lit("running"), attempts: F.col(attempts) + 1})


def recovered(kind: Column, status: Column) -> Column:
    """After a crash: running tasks wait again; open runs failed; a digest being sent has an unknown outcome."""
    return (
        F.when((kind == "task") & (status == "running"), "queued")
        .when((kind == "run") & status.isin("queued", "running"), "failed")
        .when((kind == "digest") & (status == "sending"), "uncertain")
        .otherwise(status)
    )


def run_status(failures: Column, total: Column) -> Column:
    return F.when((failures > 0) & (failures < total), "partial").when(failures > 0, "failed").otherwise("completed")


def run_summary(results: DataFrame, run: str, failed: Column, message: Column) -> DataFrame:
    """(run, status, failures, total, error) of per-source results; messages in order, joined."""
    return results.groupBy(run).agg(F.count_if(failed).alias("failures"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(failed, message))), "；").alias("error")).select(run, run_status(F.col("failures"), F.col("total")).alias("status"), "failures", "total", "error")


def active_run(df: DataFrame, seq: str = "seq", status: str = "status") -> DataFrame:
    """The open run that a new trigger joins instead of starting another."""
    return df.where(F.col(status).isin("queued", "running")).orderBy(F.desc(seq)).limit(1)


def task_grid(kinds: DataFrame, tasks: DataFrame, kind: str = "kind") -> DataFrame:
    """Every known kind with its task, if any."""
    return kinds.join(tasks, kind, "left")
