"""Practice conversations: branching, statistics, provenance of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns (fixed values).
EVIDENCE, OWNERSHIP = r"(?i)\d|验证|评估|实验|baseline|evaluat|test", r"(?i)我|本人|负责|(?<![\p{L}\p{N}_])I(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])my(?![\p{L}\p{N}_])"
STRUCTURE, COMPARISON = r"(?i)首先|目标|结果|问题|because|result|goal|first", r"(?i)对比|基线|baseline|对照|消融|ablation"
MAX_MESSAGES = 41


def next_focus(answer: Column, user_turns: Column) -> Column:
    """Which dimension the next question asks for."""
    return (
        F.when(~answer.rlike(r"\d"), "evidence")
        .when(~answer.rlike(OWNERSHIP), "ownership")
        .when(~answer.rlike(COMPARISON), "reliability")
        .when(user_turns % 2 == 1, "failure analysis")
        .otherwise("transfer")
    )


def states(messages: DataFrame, key: str, turn: str, role: str, text: str, k: int = 12) -> DataFrame:
    """One row a conversation: user turns, last answer, next focus, the last k messages' turns, whether it's the user's turn last."""
    each = messages.groupBy(key).agg(
        F.count_if(F.col(role) == "user").alias("user_turns"),
        F.max_by(text, F.when(F.col(role) == "user", F.col(turn))).alias("answer"),
        F.max_by(role, turn).alias("last_role"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    last = F.slice("turns", F.greatest(F.size("turns") - (k - 1), F.lit(1)), k)
    return each.select(key, "user_turns", F.substring(F.trim("answer"), 1, 100).alias("excerpt"), next_focus(F.coalesce("answer", F.lit("")), F.col("user_turns")).alias("focus"), last.alias("last_turns"), "last_role")


def review(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """User answers as rounds from 1 with flags for evidence, ownership and structure."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(turn)
    user = messages.where(F.col(role) == "user")
    return user.select(key, F.row_number().over(w).alias("round"), F.substring(text, 1, 200).alias("answer_excerpt"), F.col(text).rlike(EVIDENCE).alias("has_evidence"), F.col(text).rlike(OWNERSHIP).alias("has_ownership"), F.col(text).rlike(STRUCTURE).alias("has_structure"))


def unverified_numbers(answers: Column, evidence: Column) -> Column:
    """Numbers of the answers that the evidence text doesn't contain, sorted as text."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(answers, F.lit("")), F.lit(r"(\d+(?:\.\d+)?%?)"), 1))
    return F.array_sort(F.filter(found, lambda n: ~F.coalesce(evidence, F.lit("")).contains(n)))
