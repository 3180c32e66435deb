"""Filling containers of fixed capacity, planned over the histogram of lengths.

Best-fit decreasing needs only how many items have each length: bins that look alike are one
group (a range of bin numbers with one residual), and a length is placed into whole groups at a
time. The plan is a list of slot ranges

    length, first_rank, first_bin, per_bin

and its size depends on the capacity, not on the data. Items then take the slots by their rank
within their length; ranks are counted in salted parts so that a length that a third of all
items share is no single task.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage

RANK_PART_ROWS = 500_000


@dataclass(frozen=True)
class SlotRange:
    """Items of `length` with ranks from first_rank on lie per_bin to a bin, from first_bin on."""

    length: int
    first_rank: int
    first_bin: int
    per_bin: int


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[list[SlotRange], int]:
    """Best-fit decreasing over counts; the slot ranges and the number of bins."""
    groups: dict[int, list[tuple[int, int]]] = {}  # residual -> (first bin, bins)
    residuals: list[int] = []
    slots: list[SlotRange] = []
    bins = 0

    def put(residual: int, first: int, n: int) -> None:
        if n and residual:
            if residual not in groups:
                groups[residual] = []
                bisect.insort(residuals, residual)
            groups[residual].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, n = groups[residual].pop()
                if not groups[residual]:
                    del groups[residual], residuals[at]
            else:
                residual, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = residual // length
            full, rest = divmod(min(left, per * n), per)
            slots.append(SlotRange(length, rank, first, per))
            put(residual - per * length, first, full)
            put(residual - rest * length, first + full, 1 if rest else 0)
            put(residual, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * per + rest
            left -= full * per + rest
    return slots, bins


def ranked(items: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """items with `rank` 0.. within group, in parts of about RANK_PART_ROWS rows."""
    parts = max(1, -(-rows // RANK_PART_ROWS))
    salted = items.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = salted.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_part").orderBy(*order)
    return (
        salted.withColumn("_k", F.row_number().over(within) - 1)
        .join(offsets, [group, "_part"])
        .select(*items.columns, (F.col("_before") + F.col("_k")).alias("rank"))
    )


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, part, size_start, size_end, container_id, capacity) of every row of sizes.

    An item longer than the capacity becomes consecutive spans, all but the last as long as a
    container; every other item is whole. Items of size null, 0 or less take no room: one row
    with a null container_id. Repeated rows are items of their own. An empty input gives an
    empty result. `sizes` is read three times: hand in a cheap or written table.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    spans = (
        sizes.select(F.col(id_col), size.alias("_size"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"int((_size - 1) div {capacity})"), F.lit(0)))))
        .select(
            id_col,
            "part",
            (F.col("part") * F.lit(capacity).cast("bigint")).alias("size_start"),
            F.least(F.col("_size"), (F.col("part") + 1) * F.lit(capacity).cast("bigint")).alias("size_end"),
        )
        .withColumn("_length", (F.col("size_end") - F.col("size_start")).cast("int"))
    )
    # at most `capacity` rows, however many items there are
    counts = {r["_length"]: r["n"] for r in spans.where("_length > 0").groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = plan_slots(counts, capacity)
    spark = sizes.sparkSession
    plan = spark.createDataFrame(
        [(s.length, s.first_rank, s.first_bin, s.per_bin) for s in slots],
        "_length int, first_rank bigint, first_bin bigint, per_bin int",
    )
    by_length = plan.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "first_bin", "per_bin"))).alias("_slots"))
    placed = (
        ranked(spans.where("_length > 0"), "_length", [id_col, "part"], sum(counts.values()))
        .join(F.broadcast(by_length), "_length")  # bounded by the capacity
        .withColumn("_slot", F.expr("element_at(_slots, size(filter(_slots, s -> s.first_rank <= rank)))"))
        .select(id_col, "part", "size_start", "size_end", F.expr("_slot.first_bin + (rank - _slot.first_rank) div _slot.per_bin").alias("container_id"))
    )
    roomless = spans.where("_length = 0").select(id_col, "part", "size_start", "size_end", F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(roomless).withColumn("capacity", F.lit(capacity))


def pack_documents(docs: DataFrame, capacity: int, count, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack() of documents sized by `count` (a Column function of the text), counted once and written."""
    return pack(cut_lineage(docs.select(id_col, count(F.col(text_col)).alias("n_tokens"))), capacity, id_col)
