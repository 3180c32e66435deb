"""Violations of integrity rules as one long table (rule, key, detail)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """V01-V03, V09, V13. Keys that stand more than once; keys with a null are none."""
    full = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    n = df.where(full).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return n.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.concat(F.col("_n").cast("string"), F.lit(" rows")).alias("detail"))


def broken(df: DataFrame, rule: str, key: str, wrong: Column, detail: Column) -> DataFrame:
    """V04-V08, V10, V11. Rows for which a predicate holds."""
    return df.where(F.coalesce(wrong, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def orphans(df: DataFrame, rule: str, key: str, parent: DataFrame, on: str) -> DataFrame:
    """V12, V14. Rows whose parent does not exist."""
    lost = df.where(F.col(on).isNotNull()).join(parent.select(on).distinct(), on, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(on).cast("string").alias("detail"))


def all_of(*parts: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
