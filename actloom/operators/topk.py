"""Prioritised selection with pools, caps per group and removal of repeats, as ranking windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """H03, K08, L02, I03. The first row of each key; end `order` with something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """E17, I07, I08. The first n rows of each key with their rank. Spark keeps n rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def pooled(df: DataFrame, keys: Sequence[str], primary: Column, order: Sequence[Column | str], n: int, n_fallback: int) -> DataFrame:
    """G01, H02. The first n primary rows of each key; where a key has none, its first n_fallback rows.
    Adds rank, scope ('primary' or 'fallback') and n_truncated."""
    marked = df.withColumn("_p", F.coalesce(primary, F.lit(False)))
    group = Window.partitionBy(*keys)
    marked = marked.withColumn("_any", F.max("_p").over(group)).where("_p or not _any")
    w = group.orderBy(*order)
    limit = F.when(F.col("_any"), n).otherwise(n_fallback)
    out = marked.withColumns({"rank": F.row_number().over(w), "_n": F.count(F.lit(1)).over(group)}).where(F.col("rank") <= limit)
    return out.withColumns({"scope": F.when(F.col("_any"), "primary").otherwise("fallback"), "n_truncated": F.greatest(F.col("_n") - limit, F.lit(0))}).drop("_p", "_any", "_n")


def diversified(df: DataFrame, keys: Sequence[str], kind: str, order: Sequence[Column | str], n: int, per_kind: int = 2) -> DataFrame:
    """H04. n rows of each key: first one of each kind, then seconds, at most per_kind of a kind."""
    w = Window.partitionBy(*keys, kind).orderBy(*order)
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_kind)
    return top(ranked, keys, ["_k", *order], n, "pick").drop("_k")


def with_choices(df: DataFrame, keys: Sequence[str], answer: str, pick: str, generic: Sequence[str]) -> DataFrame:
    """H06. choices: the answer and two others of its key, filled up from a generic pool, rotated by pick."""
    pool = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(pick, answer))), lambda x: x[answer]).alias("_pool"))
    out = df.join(pool, list(keys))
    others = F.array_distinct(F.filter(F.concat("_pool", F.array(*[F.lit(g) for g in generic])), lambda x: x != F.col(answer)))
    three = F.concat(F.array(F.col(answer)), F.slice(others, 1, 2))
    turn = F.pmod(F.col(pick) - 1, F.size(three))
    size = F.size(three)
    turned = F.concat(F.slice(three, size - turn + 1, F.greatest(turn, F.lit(0))), F.slice(three, F.lit(1), size - turn))
    return out.withColumns({"choices": turned, "correct_index": turn.cast("int")}).drop("_pool")


def rank_fallback(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, left_order: str, right_order: str) -> DataFrame:
    """D21. (keys, left_order, right_order, by): rows of left with their row of right by id; those without
    one take the k-th row of right that no id has used. Ids are unique on the right."""
    r = right.select(*keys, F.col(on).alias("_on"), F.col(right_order).alias("_r"))
    first = left.select(*keys, F.col(on).alias("_on"), F.col(left_order).alias("_l")).join(r, [*keys, "_on"], "left")
    used = first.where("_r is not null").select(*keys, "_r").distinct()
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    open_left = first.where("_r is null").select(*keys, "_l", F.row_number().over(w("_l")).alias("_k"))
    open_right = r.select(*keys, "_r").distinct().join(used, [*keys, "_r"], "left_anti").withColumn("_k", F.row_number().over(w("_r")))
    by_id = first.where("_r is not null").select(*keys, "_l", "_r", F.lit("id").alias("by"))
    by_rank = open_left.join(open_right, [*keys, "_k"], "left").select(*keys, "_l", "_r", F.when(F.col("_r").isNull(), "none").otherwise("rank").alias("by"))
    return by_id.unionByName(by_rank).select(*keys, F.col("_l").alias(left_order), F.col("_r").alias(right_order), "by")
