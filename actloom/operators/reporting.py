"""Grading, roll-ups and traces: joins on pre-aggregated branches and conditional aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions.text import safe_divide
from actloom.operators.topk import top


def graded(answers: DataFrame, keys: Sequence[str], correct: Column, answered: Column, passed_from: float = 70.0) -> DataFrame:
    """I02, I05. Per attempt: n_total, n_answered, n_correct, n_wrong, n_unanswered, percent, passed."""
    out = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(answered).alias("n_answered"), F.count_if(answered & correct).alias("n_correct")
    )
    percent = F.bround(safe_divide(F.col("n_correct") * 100, F.col("n_total")), 2)
    return out.withColumns({"n_wrong": F.greatest(F.col("n_answered") - F.col("n_correct"), F.lit(0)), "n_unanswered": F.greatest(F.col("n_total") - F.col("n_answered"), F.lit(0)), "percent": percent, "passed": percent >= passed_from})


def verdict(percent: Column, passed_from: float = 70.0) -> Column:
    """I05. Five steps."""
    return F.when(percent >= 90, "excellent").when(percent >= 80, "good").when(percent >= passed_from, "passed").when(percent >= passed_from - 15, "close").otherwise("failed")


def group_report(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I08. Per group of attempts: count, mean and best percent, pass rate."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.bround(F.avg("percent"), 6).alias("mean_percent"), F.max("percent").alias("best_percent"), F.bround(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate")
    )


def frequent_errors(wrong: DataFrame, group: str, topic: str, given: str, n: int = 5, n_given: int = 3) -> DataFrame:
    """I07. Per group the n topics with the most wrong answers, each with its n_given most frequent ones.
    Wrong answers are counted by (group, topic, given) first, so a hot topic is small before it is ranked."""
    counts = wrong.groupBy(group, topic, given).agg(F.count(F.lit(1)).alias("n_given"))
    topics = top(counts.groupBy(group, topic).agg(F.sum("n_given").alias("n_wrong")), [group], [F.desc("n_wrong"), topic], n, "topic_rank")
    return top(counts.join(topics, [group, topic]), [group, topic], [F.desc("n_given"), given], n_given, "given_rank")


def counts_by(base: DataFrame, key: str, branches: Mapping[str, DataFrame]) -> DataFrame:
    """I12-I14, J07. base with one count column for each branch; branches are counted before they are joined, so none multiplies another."""
    for name, branch in branches.items():
        n = branch.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        base = base.join(n, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return base


def trace_status(parts: Mapping[str, Column]) -> Column:
    """J04. 'complete', or the first part that is missing, in order."""
    out = F.when(F.lit(False), F.lit(""))
    for name, there in parts.items():
        out = out.when(~F.coalesce(there, F.lit(False)), f"missing_{name}")
    return out.otherwise("complete")


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """J08, J12. Upsert over an append log: the last row of each key, as one aggregate with map-side combine."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def long_form(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """J11, N15. Each field of a row becomes a row (field, value)."""
    return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", "value")


def overlay(base: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str, mark: str = "corrected") -> DataFrame:
    """D19, E19. base with the column taken from corrections where there is one."""
    fix = corrections.select(*keys, F.col(column).alias("_fix"))
    return base.join(fix, list(keys), "left").withColumns({mark: F.col("_fix").isNotNull(), column: F.coalesce("_fix", column)}).drop("_fix")
