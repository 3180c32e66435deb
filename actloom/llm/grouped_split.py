"""Train, validation and test splits that keep related records together.

Related records are the connected components of a graph whose vertices are the key values (a
document, a pair), not the records: a record with two keys is one edge, and edges are made
distinct before anything else, so a key that a third of all records share is one vertex with
distinct neighbours. Components come from random-mate contraction: each round every vertex
throws a coin, a vertex on tails joins a neighbour on heads, and edges are renamed; the edges
are gone after about log(n) rounds. The written map of each round is unwound at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage

SPLITS = ("train", "validation", "test")
BUCKETS = 4096


def clean_key(value: Column) -> Column:
    """A key without the letter case and white space around it; null if nothing is left."""
    out = F.lower(F.regexp_replace(value, r"(?U)^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))
    return F.when(F.length(out) > 0, out)


@dataclass(frozen=True)
class Strategy:
    """What holds the records of one strategy together: no field, one, or several."""

    name: str
    fields: tuple[str, ...] = ()
    shares: tuple[float, float, float] = (0.8, 0.1, 0.1)
    seed: int = 0
    stand_ins: Mapping[str, str] = field(default_factory=dict)

    def nodes(self) -> list[Column]:
        """The vertices that a record names, each tagged with its field; null where it has no value."""

        def tagged(name: str) -> Column:
            return F.concat(F.lit(f"{name}="), clean_key(F.col(name)))

        if len(self.fields) == 1 and (other := self.stand_ins.get(self.fields[0])):
            return [F.coalesce(tagged(self.fields[0]), tagged(other))]
        return [tagged(name) for name in self.fields]


def written(df: DataFrame) -> tuple[DataFrame, bool]:
    """df as a written table, and whether any of its rows are edges. (An Observation would count them in
    the write, but it leaves the session with an object that models cannot be serialised with.)"""
    table = cut_lineage(df)
    return table, not table.where("is_edge").isEmpty()


def contract(edges: DataFrame, ns: str = "ns", seed: int = 1, most_rounds: int = 200) -> DataFrame:
    """(ns, node, root) of every vertex of edges (ns, a, b); root is one vertex of its component.

    Null ends and loops are left out; repeated and reversed edges count once. No edges, no rows.
    Vertices are numbered once, so the rounds move 64-bit numbers. A round writes its
    map and the renamed edges to the checkpoint folder as one table.
    Joins are equi-joins on a vertex against a map with one row a vertex, which AQE splits if hot.
    """
    named = edges.where("a is not null and b is not null and a <> b").select(ns, "a", "b").distinct()
    ends = named.select(ns, F.explode(F.array("a", "b")).alias("node")).distinct()
    vertices = cut_lineage(ends.withColumn("v", F.monotonically_increasing_id()))  # written: the numbers stay
    number = lambda end: vertices.select(ns, F.col("node").alias(end), F.col("v").alias(f"_{end}"))
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    numbered = named.join(number("a"), [ns, "a"]).join(number("b"), [ns, "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    left, more = written(numbered.select(lo, hi).distinct().withColumn("is_edge", F.lit(True)))
    maps: list[DataFrame] = []
    while more:
        if len(maps) == most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")

        def heads(node: str, at: int = len(maps)) -> Column:
            return F.pmod(F.xxhash64(node, F.lit(seed), F.lit(at)), F.lit(2)) == 1

        ends = left.select("a", "b", heads("a").alias("ha"), heads("b").alias("hb")).where("ha <> hb")
        step = ends.select(F.when(F.col("ha"), F.col("b")).otherwise(F.col("a")).alias("node"), F.when(F.col("ha"), F.col("a")).otherwise(F.col("b")).alias("root"))
        step = step.groupBy("node").agg(F.min("root").alias("root"))

        def renamed(df: DataFrame, end: str, step: DataFrame = step) -> DataFrame:
            to = step.select(F.col("node").alias(end), F.col("root").alias("_to"))
            return df.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")

        fewer = renamed(renamed(left.select("a", "b"), "a"), "b").where("a <> b").select(lo, hi).distinct()
        both, more = written(fewer.withColumn("is_edge", F.lit(True)).unionByName(step.select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(False).alias("is_edge"))))
        maps.append(both.where("not is_edge").select(F.col("a").alias("node"), F.col("b").alias("root")))
        left = both.where("is_edge").select("a", "b")
    if not maps:
        return vertices.select(ns, "node", F.col("node").alias("root"))
    known = maps.pop()
    while maps:
        step = maps.pop()
        resolved = step.join(known.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        known = known.unionByName(resolved)
        if len(maps) % 2 == 0:  # it is read twice a step: uncut, the plan would double each time
            known = cut_lineage(known)
    labelled = vertices.join(known.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    return labelled.select(ns, "node", F.col("root").cast("string").alias("root"))


def with_groups(records: DataFrame, strategies: Sequence[Strategy], ns: str = "split_strategy", id_col: str = "example_id") -> DataFrame:
    """records with `group_key`: equal for records of a strategy that must not part.

    Records of a strategy that is not listed are left out. A record without a value in any of
    its fields (null, empty, blank) is alone under a key of its own. Other columns are kept, but
    for a group_key that is there already: it is replaced. Repeated rows stay repeated.
    """
    records = records.drop("group_key")
    depth = max([1, *(len(s.fields) for s in strategies)])

    def node(k: int) -> Column:
        cases = [(s.name, s.nodes()[k]) for s in strategies if k < len(s.nodes())]
        return functools.reduce(lambda c, x: c.when(F.col(ns) == x[0], x[1]), cases, F.when(F.lit(False), F.lit(""))) if cases else F.lit(None).cast("string")

    listed = records.where(F.col(ns).isin([s.name for s in strategies]))
    keyed = listed.select("*", *[node(k).alias(f"__n{k}") for k in range(depth)])
    first = F.coalesce(*[F.col(f"__n{k}") for k in range(depth)])
    keyed = keyed.withColumn("__first", first)
    if depth == 1:
        return keyed.withColumn("group_key", F.coalesce("__first", F.concat(F.lit("alone="), F.col(id_col).cast("string")))).drop("__n0", "__first")
    pairs = keyed.select(ns, "__first", F.explode(F.array(*[F.col(f"__n{k}") for k in range(1, depth)])).alias("b"))
    roots = contract(pairs.select(ns, F.col("__first").alias("a"), "b"), ns).select(ns, F.col("node").alias("__first"), F.col("root").alias("__root"))
    return (
        keyed.join(roots, [ns, "__first"], "left")
        .withColumn("group_key", F.coalesce(F.concat(F.lit("component="), F.col("__root")), "__first", F.concat(F.lit("alone="), F.col(id_col).cast("string"))))
        .select(*records.columns, "group_key")
    )


def parted_groups(grouped: DataFrame, ns: str = "split_strategy", split: str = "split") -> DataFrame:
    """The records of groups that lie in more than one split; a null split counts as one of its own."""
    where = F.coalesce(F.col(split), F.lit(""))
    parted = grouped.groupBy(ns, "group_key").agg(F.min(where).alias("_lo"), F.max(where).alias("_hi")).where("_lo <> _hi")
    return grouped.join(parted.select(ns, "group_key"), [ns, "group_key"], "left_semi")


def assign(grouped: DataFrame, strategies: Sequence[Strategy], ns: str = "split_strategy") -> DataFrame:
    """(ns, group_key, assigned): a split for every group, by cumulative weight.

    The groups of a strategy stand in one order, the heaviest first and those of one weight by a
    seeded hash. A group belongs to the split in whose stretch of the running sum its middle lies,
    so where a split ends the shares are missed by half a group at most, and the groups there are
    light unless all are heavy. Ties of the hash go by the key. The running sum is taken over
    weights (at most the root of twice the number of rows), over hash buckets of a weight, and then
    within each bucket by rank; no task sees the groups of a weight as a whole.
    """
    order = functools.reduce(lambda c, s: c.when(F.col(ns) == s.name, F.xxhash64(F.lit(s.seed), "group_key")), strategies, F.when(F.lit(False), F.lit(0)))
    weights = grouped.groupBy(ns, "group_key").agg(F.count(F.lit(1)).alias("weight")).withColumn("_h", order)
    weights = cut_lineage(weights.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - BUCKETS.bit_length() + 1)))
    cells = weights.groupBy(ns, "weight", "_bucket").agg(F.sum("weight").alias("_w"))
    heavier = Window.partitionBy(ns).orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(ns, "weight").agg(F.sum("_w").alias("_w"))
    above = sums.select(ns, "weight", F.coalesce(F.sum("_w").over(heavier), F.lit(0)).alias("_above"))
    before = Window.partitionBy(ns, "weight").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(ns, "weight", "_bucket", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before")).join(above, [ns, "weight"])
    within = Window.partitionBy(ns, "weight", "_bucket").orderBy("_h", "group_key")
    placed = weights.withColumn("_k", F.row_number().over(within)).join(starts, [ns, "weight", "_bucket"])
    middle = F.col("_above") + F.col("_before") + F.col("weight") * (F.col("_k") - 0.5)
    totals = {r[ns]: r["n"] for r in sums.groupBy(ns).agg(F.sum("_w").alias("n")).collect()}  # one row a strategy
    cases = F.when(F.lit(False), F.lit(""))
    for s in strategies:
        share = [x * totals.get(s.name, 0) / (sum(s.shares) or 1) for x in s.shares]
        at = F.col(ns) == s.name
        cases = cases.when(at & (middle < share[0]), SPLITS[0]).when(at & (middle < share[0] + share[1]), SPLITS[1]).when(at, SPLITS[2])
    return placed.select(ns, "group_key", cases.alias("assigned"))
