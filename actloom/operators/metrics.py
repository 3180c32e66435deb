"""Evaluation: confusion tables, precision and recall, matching of expected against found."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actloom.functions.text import safe_divide


def confusion(df: DataFrame, keys: Sequence[str], true: str, predicted: str) -> DataFrame:
    """N01. Counts of (true, predicted) per key; rows without either label are left out."""
    return df.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys, true, predicted).agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame, keys: Sequence[str], true: str, predicted: str, digits: int = 4) -> DataFrame:
    """N02. Precision, recall and F1 of each label from a confusion table. The table is unpivoted
    into true and predicted counts instead of being joined with the labels."""
    side = F.explode(
        F.array(
            F.struct(F.col(true).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
        )
    )
    sums = cells.select(*keys, side.alias("s")).groupBy(*keys, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
    p, r = safe_divide(F.col("hits"), F.col("predicted")), safe_divide(F.col("hits"), F.col("support"))
    rated = sums.withColumns({"precision": F.bround(p, digits), "recall": F.bround(r, digits)})
    return rated.withColumn("f1", F.bround(safe_divide(F.lit(2.0) * p * r, p + r), digits))


def summary(classes: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """N04. Accuracy, macro and weighted F1 per key."""
    return classes.groupBy(*keys).agg(
        F.bround(safe_divide(F.sum("hits"), F.sum("support")), digits).alias("accuracy"),
        F.bround(F.avg("f1"), 12).alias("macro_f1"),  # of rounded values: more digits, or ties would decide
        F.bround(safe_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 12).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def binary(df: DataFrame, keys: Sequence[str], true: Column, predicted: Column, digits: int = 4) -> DataFrame:
    """N03. Precision, recall and F1 of a yes/no question."""
    t, p = F.coalesce(true, F.lit(False)), F.coalesce(predicted, F.lit(False))
    out = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    out = out.withColumns({"precision": safe_divide(F.col("tp"), F.col("tp") + F.col("fp"), digits), "recall": safe_divide(F.col("tp"), F.col("tp") + F.col("fn"), digits)})
    return out.withColumn("f1", safe_divide(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn"), digits))


def roc_auc(df: DataFrame, keys: Sequence[str], positive: Column, score: str) -> DataFrame:
    """N05. Area under the ROC curve. Scores are counted first, ranks then run over distinct scores only."""
    pos = F.coalesce(positive, F.lit(False))
    counted = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = counted.withColumn("_won", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2))
    out = won.groupBy(*keys).agg(F.sum("_won").alias("_won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*keys, F.bround(safe_divide(F.col("_won"), F.col("p") * F.col("n")), 6).alias("auc"))


def contained_matches(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """N06. (key, expected_id, found_id): each expected text, in order, takes the shortest unused found
    text of its key that contains it. expected: key, expected_id, text; found: key, found_id, text.
    Candidates are joined and filtered in the JVM; the greedy pass sees those only."""
    cand = expected.select(key, "expected_id", F.col("text").alias("_e")).join(found.select(key, "found_id", F.col("text").alias("_f")), key)
    cand = cand.where((F.length("_e") > 0) & F.contains("_f", "_e")).select(key, "expected_id", "found_id", F.length("_f").alias("size"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for e, group in pdf.sort_values(["expected_id", "size", "found_id"]).groupby("expected_id", sort=True):
            for r in group.itertuples(index=False):
                if r.found_id not in used:
                    used.add(r.found_id)
                    rows.append((getattr(r, key), e, r.found_id))
                    break
        return pd.DataFrame(rows, columns=[key, "expected_id", "found_id"])

    kinds = dict(cand.dtypes)
    return cand.groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, expected_id {kinds['expected_id']}, found_id {kinds['found_id']}")


def micro_macro(df: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """N07, N09. Micro (ratio of sums) and macro (mean of ratios) precision, recall and F1 of rows with tp, fp, fn."""
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.bround(F.avg(p), digits).alias("macro_precision"), F.bround(F.avg(r), digits).alias("macro_recall"))
    out = out.withColumns({"micro_precision": safe_divide(F.col("tp"), F.col("tp") + F.col("fp"), digits), "micro_recall": safe_divide(F.col("tp"), F.col("tp") + F.col("fn"), digits)})
    return out.withColumn("micro_f1", safe_divide(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("fp") + F.col("fn"), digits))


def topic_covered(topic_words: Column, text: Column, least: float = 0.55) -> Column:
    """N10. Every number of the topic and at least `least` of its words stand in the text."""
    low = F.lower(text)
    n = F.size(topic_words)
    hit = F.size(F.filter(topic_words, lambda w: F.contains(low, w)))
    numbers = F.forall(topic_words, lambda w: ~w.rlike("^[0-9]+$") | F.contains(low, w))
    return F.coalesce((n > 0) & numbers & (hit >= n * least), F.lit(False))


def gate(value: Column, least: float) -> Column:
    """O05. Whether a suite passes."""
    return F.coalesce(value >= least, F.lit(False))


def similar_matches(expected: DataFrame, found: DataFrame, key: str, least: float = 0.72) -> DataFrame:
    """N08. (key, expected_id, found_id, score): each expected text, in order, takes the most similar
    unused found text of its key from `least` on; one that contains the other and has 16 characters
    counts as 1. The texts of a key, bounded by a document, meet once."""
    from actloom.operators.matching import ratio

    side = lambda df, i, n: df.select(key, F.col(i).alias("_id"), F.coalesce("text", F.lit("")).alias("_t"), F.lit(n).alias("_n"))
    both = side(expected, "expected_id", 0).unionByName(side(found, "found_id", 1))

    def score(a: str, b: str) -> float:
        return 1.0 if min(len(a), len(b)) >= 16 and (a in b or b in a) else ratio(a, b)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        left, right, rows = pdf[pdf._n == 0], pdf[pdf._n == 1], []
        free = dict(zip(right._id, right._t))
        for i, t in zip(left._id, left._t):
            best = max(((score(t, u), -j, j) for j, u in free.items()), default=(0.0, 0, None))
            if best[2] is not None and best[0] >= least:
                del free[best[2]]
                rows.append((pdf[key].iloc[0], i, best[2], round(best[0], 4)))
        return pd.DataFrame(rows, columns=[key, "expected_id", "found_id", "score"])

    kinds = dict(both.dtypes)
    return both.groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, expected_id {kinds['_id']}, found_id {kinds['_id']}, score double")
