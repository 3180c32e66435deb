"""Exact vector search with filters before and a lexical rerank after, for whole query tables.

Queries are a stated set. They come in blocks and the rows in slices; a task holds a block and a
slice and keeps its best k of every query, so only slices x queries x k rows go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions.text import collapse, word_set
from actloom.operators.topk import top

BLOCK = 4096  # queries of a task
SLICE = 50_000  # rows of a task


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """K03. A vector of length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """K05, K10. Cosine similarity in the JVM, 0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def embedding_text(heading: Column, path: Column, text: Column) -> Column:
    """K01. Heading, section path where it differs, text."""
    return F.concat_ws("\n", F.when(F.length(heading) > 0, heading), F.when((F.length(path) > 0) & ~path.eqNullSafe(heading), path), text)


def matrix(table: pa.Table, vector: str) -> np.ndarray:
    """Vectors of a column as rows of length 1; a zero vector stays as it is."""
    m = np.stack([np.asarray(v, np.float64) for v in table[vector].to_pylist()])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """K05. (query_id, id, score, rank): for each query its k rows of the highest cosine; a row is no match of itself.

    Null vectors match nothing. Queries are hashed into blocks and rows into slices, and every block
    meets every slice in a task of its own on the executors: each holds one of either, keeps its best k
    of every query, and only those go on. Nothing but two counts comes to the driver.
    """
    queries, rows = queries.where(F.col(vector).isNotNull()).select(id_col, vector), rows.where(F.col(vector).isNotNull()).select(id_col, vector)
    blocks, slices = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // slice_rows))
    part = lambda of: F.pmod(F.xxhash64(id_col), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = queries.select(id_col, vector, part(blocks).alias("_block"), every(slices).alias("_slice"))
    right = rows.select(id_col, vector, every(blocks).alias("_block"), part(slices).alias("_slice"))

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, found = q[id_col].to_numpy(), ([], [], [])
        if q.num_rows and r.num_rows:
            asked = matrix(q, vector)
            top_score, top_id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
            for at in range(0, r.num_rows, 4096):
                some = r.slice(at, 4096)
                own = some[id_col].to_numpy()
                score = asked @ matrix(some, vector).T
                score[ids[:, None] == own[None, :]] = -np.inf
                all_score = np.concatenate([top_score, np.round(score, 12)], 1)
                all_id = np.concatenate([top_id, np.broadcast_to(own, score.shape)], 1)
                order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
                top_score, top_id = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)
            good = np.isfinite(top_score)
            found = (np.repeat(ids, k)[good.ravel()], top_id[good], top_score[good])
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", id_col, "score"])

    met = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice")).applyInArrow(best, f"query_id bigint, {id_col} bigint, score double")
    return top(met, ["query_id"], [F.desc("score"), id_col], k)


def lexical_bonus(query: str, heading: Column, path: Column, text: Column) -> Column:
    """K06. Weights for the phrase and for its words in heading, path and text."""
    phrase = " ".join(query.lower().split())
    words = [w for w in dict.fromkeys(phrase.split()) if w]
    total = F.lit(0.0)
    for field, whole, each in ((heading, 0.35, 0.12), (path, 0.25, 0.08), (text, 0.60, 0.18)):
        low = collapse(F.lower(F.coalesce(field, F.lit(""))))
        total = total + F.when(F.contains(low, F.lit(phrase)), whole).otherwise(0.0)
        for w in words:
            total = total + F.when(F.contains(low, F.lit(w)), each).otherwise(0.0)
    return F.bround(total, 6)


def lexical_search(chunks: DataFrame, query: str, k: int, keys: list[str]) -> DataFrame:
    """K06-K08 without vectors: the k best chunks by bonus, each text of a heading once."""
    scored = chunks.withColumn("bonus", lexical_bonus(query, F.col("heading"), F.col("section_path"), F.col("text"))).where("bonus > 0")
    once = scored.groupBy("version_id", F.coalesce("heading", F.lit("")).alias("heading"), "text_hash").agg(F.max("bonus").alias("bonus"), F.min(F.struct(*keys)).alias("_k")).select("version_id", "heading", "_k.*", "bonus")
    return once.orderBy(F.desc("bonus"), *keys).limit(k)


def shared_words(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))
