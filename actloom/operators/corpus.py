"""Corpus construction: unions by source rank, hash-ranked splits, leakage checks and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage


def union_first_wins(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """L02, L16. Rows of all sources, each key from the first source that has it; one aggregate, no sort."""
    ranked = None
    for i, df in enumerate(sources):
        part = df.withColumn("source_rank", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "source_rank")]
    picked = ranked.groupBy(key).agg(F.min("source_rank").alias("source_rank"), F.min_by(F.struct(*rest), F.struct("source_rank", F.xxhash64(*rest))).alias("_r"))
    return picked.select(key, "_r.*", "source_rank")


def hash_order(seed: int, *cols: str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *cols), 256)


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float, seed: int = 42) -> DataFrame:
    """L06. df with split: of each label the share of rows that come first in seeded hash order is test.

    Ranks are counted in 256 stretches of the hash order, so a label of a third of all rows is no single task.
    """
    hashed = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_part", F.substring("_h", 1, 2))
    sizes = df.select(label, F.substring(hash_order(seed, id_col), 1, 2).alias("_part")).groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of_label = Window.partitionBy(label)
    before = of_label.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(label).alias("_l"), "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(of_label).alias("_all"))
    ranked = hashed.withColumn("_k", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", id_col)))
    joined = ranked.join(sizes.withColumnRenamed("_part", "_part2"), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_part2")))
    share = (F.col("_before") + F.col("_k") - 0.5) / F.col("_all")
    return joined.select(*df.columns, F.when(share <= test_share, "test").otherwise("train").alias("split"))


def running_sum(df: DataFrame, value: str, *order: Column) -> DataFrame:
    """df as a written table with `before`: the sum of value over the rows that come earlier in the order.
    Rows are sorted by range, summed up by range, and then within each range."""
    ordered = cut_lineage(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sums = ordered.groupBy("_range").agg(F.sum(value).alias("_sum"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ordered.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, "_range")
    return cut_lineage(summed.withColumn("before", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start"))


def group_split(df: DataFrame, group: str, label: str, test_share: float) -> DataFrame:
    """L05. df with split: whole groups go to test, greedily, until its target is reached.

    Groups come by falling size, then by how many rows their most frequent label has in all (of labels
    met as often the last by name), then by their key. A group is taken while the sum is below the target
    and it passes it by no more than half of the group (one row at least), or if the labels taken would
    then differ from those of all rows by less than 0.3 in total. As sizes fall, what is taken is a few
    stretches of the order, each found by an aggregate over running sums; a group taken for its labels
    alone passes the target and is the last. Rows with a null group are left out; a null label is one.
    """
    rows = df.where(F.col(group).isNotNull())
    named = F.coalesce(F.col(label).cast("string"), F.lit(""))
    per_label = cut_lineage(rows.groupBy(F.col(group).alias("_g"), named.alias("_l")).agg(F.count(F.lit(1)).alias("_n")))
    overall = {r["_l"]: r["n"] for r in per_label.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # one row a label
    n = sum(overall.values())
    target = max(1, round(n * test_share))
    in_all = F.create_map(*[x for kv in overall.items() for x in map(F.lit, kv)]) if overall else F.create_map(F.lit(""), F.lit(0))
    groups = per_label.groupBy("_g").agg(F.sum("_n").alias("size"), F.max_by("_l", F.struct("_n", "_l")).alias("_top"), F.map_from_entries(F.collect_list(F.struct("_l", "_n"))).alias("_labels"))
    groups = running_sum(groups.withColumn("_rank", F.element_at(in_all, F.col("_top"))).drop("_top"), "size", F.desc("size"), F.col("_rank"), F.col("_g"))
    fits = lambda taken: taken + F.col("size") <= target + F.greatest(F.lit(1), F.expr("size div 2"))
    within = lambda a, b: (F.col("before") >= a) & (F.col("before") < b)
    stretches: list[tuple[int, int]] = []  # of the running sum
    taken, at, counts = 0, 0, dict.fromkeys(overall, 0)
    while taken < target:
        ahead = groups.where(F.col("before") >= at)
        share = lambda x: F.coalesce(F.element_at("_labels", F.lit(x)), F.lit(0)) + counts[x]  # noqa: B023, E731
        apart = sum((F.abs(share(x) / target - overall[x] / n) for x in overall), F.lit(0.0))
        first = ahead.where(fits(F.lit(taken)) | (apart < 0.3)).agg(F.min_by(F.struct("before", "size"), "before").alias("x")).first()["x"]
        if first is None:
            break
        shift = taken - first["before"]
        rest = ahead.where(F.col("before") > first["before"])
        end = rest.where((F.col("before") + shift >= target) | ~fits(F.col("before") + shift)).agg(F.min("before").alias("b")).first()["b"]
        end = n if end is None else end
        stretches.append((first["before"], end))
        taken, at = end + shift, end
        got = groups.where(within(first["before"], end)).select(F.explode("_labels").alias("_l", "_n")).groupBy("_l").agg(F.sum("_n").alias("n")).collect()
        for r in got:
            counts[r["_l"]] += r["n"]
    chosen = F.lit(False)
    for a, b in stretches:
        chosen = chosen | within(a, b)
    return rows.join(groups.select(F.col("_g").alias(group), F.when(chosen, "test").otherwise("train").alias("split")), group)


def leakage(df: DataFrame, ns: str, split: str, key: str) -> DataFrame:
    """L10. (ns, split_a, split_b, n_shared): keys that stand in both of two splits; a key is counted once, in one aggregate."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(ns, key).agg(F.array_sort(F.collect_set(split)).alias("_s")).where("size(_s) > 1")
    pairs = F.explode(F.expr("flatten(transform(_s, (a, i) -> transform(slice(_s, i + 2, size(_s)), b -> struct(a AS split_a, b AS split_b))))"))
    return per_key.select(ns, pairs.alias("p")).groupBy(ns, "p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_shared"))


def missing_labels(df: DataFrame, ns: str, split: str, label: str) -> DataFrame:
    """L11. (ns, split, label) of labels that a strategy has but one of its splits lacks."""
    seen = df.where(F.col(label).isNotNull()).select(ns, split, label).distinct()
    wanted = seen.select(ns, label).distinct().join(seen.select(ns, split).distinct(), ns)
    return wanted.join(seen, [ns, split, label], "left_anti").select(ns, split, label)


def leaking_features(columns: Sequence[str], blocked: Sequence[str]) -> list[str]:
    """L12. Column names that carry the answer."""
    return sorted(c for c in columns if any(b in c.lower() for b in blocked))


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """L13. (field, value, n) of several columns in one pass."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns]).unpivot([], list(columns), "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def leave_one_out(df: DataFrame, column: str, held_out: str, id_col: str, seed: int, validation_share: float) -> DataFrame:
    """L15. df with split: rows of one source are test, the others train or validation by seeded hash."""
    u = F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(F.coalesce(F.col(column) == held_out, F.lit(False)), "test").when(u < validation_share, "validation").otherwise("train"))


def label_minimums(df: DataFrame, label: str, id_col: str, target: str, donor: str, least: int, parts: int = 64) -> DataFrame:
    """L07. df with split changed: of each label, the first donor rows by id move to target until it has `least`.

    The first `least` donors of a label are found in parts and then among those, so no task ranks all rows
    of a label. Ids are taken to be unique. A label without target rows counts as having none."""
    have = df.groupBy(label).agg(F.count_if(F.col("split") == target).alias("_have"))
    donors = df.where(F.col("split") == donor).select(label, id_col, F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("_part"))
    first = donors.withColumn("_k", F.row_number().over(Window.partitionBy(label, "_part").orderBy(id_col))).where(F.col("_k") <= least)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(id_col))).where(F.col("_k") <= least)
    moved = first.join(have, first[label].eqNullSafe(have[label])).where(F.col("_k") <= F.lit(least) - F.col("_have")).select(F.col(id_col).alias("_id"))
    out = df.join(moved, (F.col(id_col) == F.col("_id")) & (F.col("split") == donor), "left")
    return out.select(*[F.when(F.col("_id").isNotNull(), target).otherwise(F.col(c)).alias(c) if c == "split" else F.col(c) for c in df.columns])
