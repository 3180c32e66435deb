"""Comparison of two versions of a document, for all pairs of a corpus at once.

The unit of work is a table of pairs; the chunks of a pair come together in one shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher, unified_diff

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHORS = ("path_key", "canonical_label", "section_path")
HIGH, TEXT, SECTION = 0.97, 0.82, 0.55
ORDER = {"modified": 0, "added": 1, "removed": 2}
CHUNK_COLUMNS = ["chunk_id", "chunk_index", "fragment_type", "raw_label", "canonical_label", "path_key", "heading", "section_path", "text", "text_hash"]


def consecutive(versions: DataFrame, group: str = "document_id", number: str = "version_number", id_col: str = "version_id") -> DataFrame:
    """D02. (group, from_id, to_id): each version with the next one of its group, gaps included."""
    w = Window.partitionBy(group).orderBy(number, id_col)
    pairs = versions.select(group, F.col(id_col).alias("from_id"), F.lead(id_col).over(w).alias("to_id"))
    return pairs.where("to_id is not null")


def invalid_pairs(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """D01. (from_id, to_id, reason) of pairs that cannot be compared."""
    v = versions.select("version_id", "document_id", "version_number")
    a = v.select(F.col("version_id").alias("from_id"), F.col("document_id").alias("d0"), F.col("version_number").alias("n0"))
    b = v.select(F.col("version_id").alias("to_id"), F.col("document_id").alias("d1"), F.col("version_number").alias("n1"))
    reason = F.when(F.col("from_id") == F.col("to_id"), "same version").when(F.col("d0").isNull() | F.col("d1").isNull(), "unknown version")
    reason = reason.when(F.col("d0") != F.col("d1"), "other document").when(F.col("n0") >= F.col("n1"), "not newer")
    return pairs.join(a, "from_id", "left").join(b, "to_id", "left").withColumn("reason", reason).where("reason is not null").select("from_id", "to_id", "reason")


@F.arrow_udf(T.DoubleType())
def similarity(old: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """D09. Ratcliff-Obershelp ratio of (old, new), 1 for two empty texts, 0 for one. Not symmetric."""
    for a, b in old:
        yield pa.array([ratio(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return float(not a and not b)
    return SequenceMatcher(None, a, b).ratio()


def anchor_key(row: dict, name: str) -> tuple | None:
    """S05. The key by which chunks meet under an anchor; None if the chunk lacks it."""
    kind = row["fragment_type"] or ""
    if name == "section_path":
        return (kind, row["heading"], row["section_path"]) if row["heading"] and row["section_path"] else None
    if name == "same_index":  # the place alone, whatever the type
        return (row["chunk_index"],) if row["chunk_index"] is not None else None
    return (kind, row[name]) if row[name] else None


class Pairing:
    """The chunks of two versions that have no partner yet, in order."""

    def __init__(self, old: list[dict], new: list[dict]):
        place = lambda r: (r["chunk_index"] if r["chunk_index"] is not None else 1 << 30, r["chunk_id"])
        self.old = {r["chunk_id"]: r for r in sorted(old, key=place)}
        self.new = {r["chunk_id"]: r for r in sorted(new, key=place)}

    def take(self, a: dict, b: dict) -> tuple[dict, dict]:
        del self.old[a["chunk_id"]], self.new[b["chunk_id"]]
        return a, b

    def by_key(self, key: Callable[[dict], tuple | None]) -> Iterator[tuple[dict, dict]]:
        """The k-th old and the k-th new chunk of each key."""
        waiting: dict[tuple, list[dict]] = defaultdict(list)
        for r in self.old.values():
            if (k := key(r)) is not None:
                waiting[k].append(r)
        met = []
        for r in self.new.values():
            if (k := key(r)) is not None and waiting.get(k):
                met.append((waiting[k].pop(0), r))
        for a, b in met:
            yield self.take(a, b)

    def exact(self) -> Iterator[tuple[dict, dict, str]]:
        """D04, D05. Equal hashes: by anchor after anchor and index, then in order where nothing has an
        anchor, or a single one on each side."""
        for name in (*ANCHORS, "same_index"):
            for a, b in self.by_key(lambda r, n=name: (r["text_hash"], k) if r["text_hash"] and (k := anchor_key(r, n)) else None):
                yield a, b, name
        groups: dict[str, tuple[list[dict], list[dict]]] = defaultdict(lambda: ([], []))
        for side, rows in enumerate((self.old, self.new)):
            for r in rows.values():
                if r["text_hash"]:
                    groups[r["text_hash"]][side].append(r)
        for a, b in groups.values():
            free = not any(anchor_key(r, n) for r in (*a, *b) for n in ANCHORS)
            if a and b and (free or len(a) == len(b) == 1):
                for x, y in zip(a, b):
                    yield *self.take(x, y), "text_hash"

    def anchored(self) -> Iterator[tuple[dict, dict, str]]:
        """D06. Other text under the same anchor."""
        for name in ANCHORS:
            for a, b in self.by_key(lambda r, n=name: anchor_key(r, n)):
                yield a, b, name

    def scored(self) -> Iterator[tuple[dict, dict, str, float]]:
        """D07, D08. Leftovers that are alike, the best first. One path is enough for a match, as is one label
        of a kind; only pairs with one of these, one section path, one heading of a kind, or a place near
        by are compared, since no other can be a match."""
        cands = []
        paths, headings, places = defaultdict(list), defaultdict(list), defaultdict(list)
        keys, labels = defaultdict(list), defaultdict(list)
        for r in self.new.values():
            kind = r["fragment_type"] or ""
            keys[r["path_key"] or None].append(r)
            labels[kind, r["canonical_label"] or None].append(r)
            paths[r["section_path"] or None].append(r)
            headings[kind, r["heading"] or None].append(r)
            places[kind, r["chunk_index"]].append(r)
        for a in self.old.values():
            kind, at = a["fragment_type"] or "", a["chunk_index"] or 0
            near = [r for d in range(-2, 3) for r in places.get((kind, at + d), ())]
            near += paths[a["section_path"]] if a["section_path"] else []
            near += headings[kind, a["heading"]] if a["heading"] else []
            near += keys[a["path_key"]] if a["path_key"] else []
            near += labels[kind, a["canonical_label"]] if a["canonical_label"] else []
            for b in {r["chunk_id"]: r for r in near}.values():
                if a["text_hash"] and a["text_hash"] == b["text_hash"]:
                    continue
                alike = ratio(a["text"] or "", b["text"] or "")
                gap = abs(at - (b["chunk_index"] or 0))
                same_kind = kind == (b["fragment_type"] or "")
                path = bool(a["section_path"]) and a["section_path"] == b["section_path"]
                head = bool(a["heading"]) and a["heading"] == b["heading"]
                key = bool(a["path_key"]) and a["path_key"] == b["path_key"]
                label = same_kind and bool(a["canonical_label"]) and a["canonical_label"] == b["canonical_label"]
                reason = "path_key" if key else "canonical_label" if label else "section_path" if path and alike >= SECTION else "heading" if head and same_kind and alike >= TEXT else "high_text_similarity" if same_kind and alike >= HIGH and gap <= 2 else None
                if reason:
                    score = alike + {0: 0.10, 1: 0.07, 2: 0.03, 3: 0.03}.get(gap, 0.0) + 0.05 * same_kind + (0.45 if key else 0.30 if label else 0.20 * path) + 0.10 * head
                    cands.append((-score, -alike, gap, at, b["chunk_index"] or 0, a["chunk_id"], b["chunk_id"], reason))
        for _, alike, *_, i, j, reason in sorted(cands):
            if i in self.old and j in self.new:
                yield *self.take(self.old[i], self.new[j]), reason, -alike


CHANGES = "pair_id bigint, stage string, operation string, old_id bigint, new_id bigint, similarity double, match_reason string"


def version_diff(pairs: DataFrame, chunks: DataFrame, scored: bool = True, rated: bool = True) -> DataFrame:
    """D13. One row for every chunk match and leftover of every pair: CHANGES.

    pairs: pair_id, from_id, to_id. chunks: version_id and CHUNK_COLUMNS. Unchanged chunks are rows
    too (stage 'hash'), so counts need no second pass. Every pass depends on what the passes before
    have used up; as joins that is a chain of anti-joins, each a shuffle. The chunks of a pair, bounded
    by the two versions, therefore come together once, and the passes run over them in memory.
    Without `scored` leftovers are removed and added; without `rated` and `scored` texts are not shuffled.
    """
    version = F.explode(F.array(F.struct(F.col("from_id").alias("version_id"), F.lit(0).alias("side")), F.struct(F.col("to_id").alias("version_id"), F.lit(1).alias("side"))))
    columns = [c for c in CHUNK_COLUMNS if c not in ("raw_label", *(() if scored or rated else ("text",)))]
    rows = pairs.select(F.col("pair_id").cast("bigint").alias("pair_id"), version.alias("v")).select("pair_id", "v.*").join(chunks.select("version_id", *columns), "version_id").drop("version_id")

    def match(table: pa.Table) -> pa.Table:
        both: tuple[list[dict], list[dict]] = ([], [])
        for r in table.to_pylist():
            both[r["side"]].append(r)
        left, key, out = Pairing(*both), table["pair_id"][0].as_py(), []
        out += [(key, "hash", "unchanged", a["chunk_id"], b["chunk_id"], 1.0, None) for a, b, _ in left.exact()]
        out += [(key, "anchor", "modified", a["chunk_id"], b["chunk_id"], round(ratio(a["text"] or "", b["text"] or ""), 4) if rated else None, why) for a, b, why in left.anchored()]
        if scored:
            out += [(key, "scored", "modified", a["chunk_id"], b["chunk_id"], round(alike, 4), why) for a, b, why, alike in left.scored()]
        out += [(key, "left", "removed", i, None, None, None) for i in left.old] + [(key, "left", "added", None, i, None, None) for i in left.new]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        return pa.table([pa.array([r[j] for r in out], kinds[j]) for j in range(7)], names=[c.split()[0] for c in CHANGES.split(", ")])

    return rows.groupBy("pair_id").applyInArrow(match, CHANGES)


def diff_counts(changes: DataFrame) -> DataFrame:
    """D13. Counts per pair and whether the versions are identical."""
    ops = ("added", "removed", "modified", "unchanged")
    counts = changes.groupBy("pair_id").agg(*[F.count_if(F.col("operation") == o).alias(f"n_{o}") for o in ops])
    return counts.withColumn("identical", F.expr("n_added + n_removed + n_modified = 0"))


def ordered_changes(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """D14. Changes with a dense sort_order per pair: by the place in the new text, then the operation."""
    where = chunks.select(F.col("chunk_id").alias("_id"), "chunk_index", F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("path_key", "section_path", "heading")], F.lit("")).alias("_anchor"))
    primary = changes.where("operation <> 'unchanged'").withColumn("_id", F.coalesce("new_id", "old_id")).join(where, "_id")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("operation"))
    w = Window.partitionBy("pair_id").orderBy("chunk_index", "_anchor", rank, F.coalesce("old_id", F.lit(0)), F.coalesce("new_id", F.lit(0)))
    return primary.withColumn("sort_order", F.row_number().over(w)).select(*changes.columns, "sort_order")


def document_fallback(pairs: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """D11. (pair_id, operation) for pairs of which a side has no chunks: the texts as a whole."""
    n = chunks.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda at, t: versions.select(F.col("version_id").alias(at), F.coalesce("normalized_text", F.lit("")).alias(t)).join(n.withColumnRenamed("version_id", at).withColumnRenamed("n", f"n_{t}"), at, "left")
    both = pairs.join(side("from_id", "a"), "from_id").join(side("to_id", "b"), "to_id").where("n_a is null or n_b is null")
    op = F.when((F.col("a") == "") & (F.col("b") == ""), "empty").when(F.col("a") == F.col("b"), "unchanged").when(F.col("a") == "", "added").when(F.col("b") == "", "removed").otherwise("modified")
    return both.select("pair_id", op.alias("operation"))


@F.arrow_udf(T.StringType())
def line_diff(sides: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """D12. Unified diff of the lines of two texts, without timestamps."""
    for a, b in sides:
        yield pa.array(["\n".join(unified_diff((x or "").splitlines(), (y or "").splitlines(), fromfile="from_version", tofile="to_version", lineterm="")) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())


def block_diff(df: DataFrame, keys: list[str], old: str, new: str, unit: str = "line", least: float | None = None) -> DataFrame:
    """D15, D16. Baselines over lines or paragraphs: keys, operation, old_text, new_text, similarity.
    Blocks that replace each other are paired greedily from `least` on (0.62 for lines, 0.45 for paragraphs)."""
    least = (0.62 if unit == "line" else 0.45) if least is None else least
    parts = (lambda t: [x.strip() for x in t.split("\n") if x.strip()]) if unit == "line" else (lambda t: [x.strip() for x in t.split("\n\n") if x.strip()])

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                key, a, b = list(r[: len(keys)]), parts(r[len(keys)] or ""), parts(r[len(keys) + 1] or "")
                for tag, i0, i1, j0, j1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    if tag == "equal":
                        continue
                    left, right = list(range(i0, i1)), list(range(j0, j1))
                    cands = sorted(((ratio(a[i], b[j]), -abs(i - i0 - j + j0), i, j) for i in left for j in right), reverse=True)
                    used_a, used_b = set(), set()
                    for s, _, i, j in cands:
                        if s >= least and i not in used_a and j not in used_b:
                            used_a.add(i)
                            used_b.add(j)
                            rows.append([*key, "modified", a[i], b[j], round(s, 4)])
                    rows += [[*key, "removed", a[i], None, None] for i in left if i not in used_a]
                    rows += [[*key, "added", None, b[j], None] for j in right if j not in used_b]
            yield pd.DataFrame(rows, columns=[*keys, "operation", "old_text", "new_text", "similarity"])

    rows = df.select(*keys, old, new)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", operation string, old_text string, new_text string, similarity double"
    return rows.mapInPandas(diff, schema)
