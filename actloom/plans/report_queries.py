"""Queries of sections I to K: grading and roll-ups, traces, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from actloom.core.tables import load
from actloom.functions.text import truncate
from actloom.operators import reporting, search, topk
from actloom.plans.diff_queries import annotations
from actloom.plans.registry import query
from actloom.plans.text_queries import chunks, versions

# Attempts are orders, their answers the line items, the question is the part, a participant the customer.
CORRECT = "l_returnflag = 'N'"
ANSWERED = "l_linestatus = 'O'"
_GRADED = f"""g AS (SELECT l_orderkey, count(*) n_total, count(*) FILTER (WHERE {ANSWERED}) n_answered, count(*) FILTER (WHERE {ANSWERED} AND {CORRECT}) n_correct FROM lineitem GROUP BY 1),
p AS (SELECT *, round_even(n_correct * 100 / n_total::DOUBLE, 2) percent FROM g)"""


def answers(spark, sf_dir, *columns):
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", *columns)


def attempts(spark, sf_dir):
    return reporting.graded(answers(spark, sf_dir), ["l_orderkey"], F.expr(CORRECT), F.expr(ANSWERED))


@query("I02_I05_graded_attempts", f"WITH {_GRADED} SELECT l_orderkey, n_total, n_answered, n_correct, greatest(n_answered - n_correct, 0) AS n_wrong, greatest(n_total - n_answered, 0) AS n_unanswered, percent, percent >= 70 AS passed, CASE WHEN percent >= 90 THEN 'excellent' WHEN percent >= 80 THEN 'good' WHEN percent >= 70 THEN 'passed' WHEN percent >= 55 THEN 'close' ELSE 'failed' END AS verdict FROM p")
def i02(spark, sf_dir):
    return attempts(spark, sf_dir).withColumn("verdict", reporting.verdict(F.col("percent")))


@query("I03_latest_attempt", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def i03(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'O'").drop("o_orderstatus")
    return reporting.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("I06_feedback_topics", f"WITH w AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {ANSWERED} AND NOT {CORRECT}), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) k FROM w) SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ', ' ORDER BY k) AS topics FROM r WHERE k <= 2 GROUP BY 1")
def i06(spark, sf_dir):
    wrong = answers(spark, sf_dir, "l_partkey").where(f"{ANSWERED} and not {CORRECT}").select("l_orderkey", "l_partkey").distinct()
    first = topk.top(wrong, ["l_orderkey"], ["l_partkey"], 2, "k")
    return first.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ", ").alias("topics"))


@query("I07_frequent_errors", f"""
WITH w AS (SELECT l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE NOT ({CORRECT})), c AS (SELECT l_linenumber, l_suppkey, l_returnflag, count(*) n_given FROM w GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY n_wrong DESC, l_suppkey) topic_rank FROM (SELECT l_linenumber, l_suppkey, sum(n_given)::BIGINT n_wrong FROM c GROUP BY 1, 2)),
r AS (SELECT l_linenumber, l_suppkey, l_returnflag, n_given, n_wrong, topic_rank, row_number() OVER (PARTITION BY l_linenumber, l_suppkey ORDER BY n_given DESC, l_returnflag) given_rank FROM c JOIN t USING (l_linenumber, l_suppkey) WHERE topic_rank <= 5)
SELECT * FROM r WHERE given_rank <= 3""")
def i07(spark, sf_dir):
    wrong = load(spark, sf_dir, "lineitem", "l_linenumber", "l_suppkey", "l_returnflag").where(f"not ({CORRECT})")
    out = reporting.frequent_errors(wrong, "l_linenumber", "l_suppkey", "l_returnflag")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("topic_rank", "given_rank")})


@query("I08_group_report", f"WITH {_GRADED} SELECT o_custkey, count(*) AS n_attempts, round_even(avg(percent), 6) AS mean_percent, max(percent) AS best_percent, round_even(avg((percent >= 70)::INT), 4) AS pass_rate FROM p JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def i08(spark, sf_dir):
    o = load(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return reporting.group_report(attempts(spark, sf_dir).join(o, "l_orderkey"), ["o_custkey"])


@query("I08_latest_ten", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rank FROM orders) WHERE rank <= 10")
def i08b(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return topk.top(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("I12_document_stats", "SELECT document_id, count(DISTINCT version_id) AS n_versions, max(version_number) AS last_version FROM document_versions GROUP BY 1")
def i12(spark, sf_dir):
    return load(spark, sf_dir, "document_versions", "document_id", "version_id", "version_number").groupBy("document_id").agg(F.countDistinct("version_id").alias("n_versions"), F.max("version_number").alias("last_version"))


@query("I13_I14_branch_counts", """
SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation""")
def i13(spark, sf_dir):
    branches = {"n_customers": load(spark, sf_dir, "customer", F.col("c_nationkey").alias("n_nationkey")), "n_suppliers": load(spark, sf_dir, "supplier", F.col("s_nationkey").alias("n_nationkey"))}
    return reporting.counts_by(load(spark, sf_dir, "nation", "n_nationkey"), "n_nationkey", branches)


_TRACE = """
WITH a AS (SELECT DISTINCT annotation_id, change_id, pair_id, description FROM annotation),
p AS (SELECT change_id, count(DISTINCT example_id) n, count(DISTINCT example_id) FILTER (WHERE split = 'test') t FROM predictions WHERE change_id IS NOT NULL GROUP BY 1),
t AS (SELECT annotation_id, pair_id, CASE WHEN description IS NULL THEN 'missing_description' WHEN coalesce(n, 0) = 0 THEN 'missing_example' WHEN coalesce(t, 0) = 0 THEN 'missing_test' ELSE 'complete' END status, coalesce(n, 0) n_examples FROM a LEFT JOIN p USING (change_id))
"""


def traced(spark, sf_dir):
    p = load(spark, sf_dir, "predictions", "change_id", "example_id", "split").where("change_id is not null")
    n = p.groupBy("change_id").agg(F.countDistinct("example_id").alias("n"), F.countDistinct(F.when(F.col("split") == "test", F.col("example_id"))).alias("t"))
    a = annotations(spark, sf_dir, "change_id", "pair_id", "description").join(n, "change_id", "left")
    status = reporting.trace_status({"description": F.col("description").isNotNull(), "example": F.col("n") > 0, "test": F.col("t") > 0})
    return a.select("annotation_id", "pair_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_examples"))


@query("J04_J05_change_trace", _TRACE + "SELECT * FROM t")
def j04(spark, sf_dir):
    return traced(spark, sf_dir)


@query("J06_J07_completeness", _TRACE + "SELECT pair_id, count(*) AS n_changes, count(*) FILTER (WHERE status = 'complete') AS n_complete, count(*) FILTER (WHERE status = 'missing_example') AS n_missing_example, sum(n_examples)::BIGINT AS n_examples FROM t GROUP BY 1")
def j06(spark, sf_dir):
    t = traced(spark, sf_dir)
    return t.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_changes"), F.count_if(F.col("status") == "complete").alias("n_complete"), F.count_if(F.col("status") == "missing_example").alias("n_missing_example"), F.sum("n_examples").alias("n_examples"))


@query("J08_J12_latest_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def j08(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id")
    return reporting.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("J11_unpivot_export", "SELECT annotation_id, unnest(['pair_id', 'document_type', 'change_type', 'importance']) AS field, unnest([pair_id, document_type, change_type, importance]) AS value FROM (SELECT DISTINCT annotation_id, pair_id, document_type, change_type, importance FROM annotation)")
def j11(spark, sf_dir):
    fields = ["pair_id", "document_type", "change_type", "importance"]
    return reporting.long_form(annotations(spark, sf_dir, *fields), ["annotation_id"], fields)


_DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("K03_unit_vectors", f"SELECT vec_id, round_even({_NORM.format('embedding')}, 6) AS norm FROM embeddings")
def k03(spark, sf_dir):
    return load(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.bround(search.norm(F.col("embedding")), 6).alias("norm"))


@query("K04_latest_versions", "SELECT document_id, max_by(version_id, (version_number, version_id)) AS version_id FROM document_versions GROUP BY 1")
def k04(spark, sf_dir):
    v = versions(spark, sf_dir, "document_id", "version_number")
    return v.groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("version_id"))


@query("K05_nearest_vectors", f"""
WITH q AS (SELECT vec_id query_id, embedding q, {_NORM.format('embedding')} nq FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round({_DOT} / (nq * {_NORM.format('embedding')}), 12) score FROM q JOIN embeddings ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, vec_id, round_even(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def k05(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all rows."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    out = search.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return out.select("query_id", "vec_id", F.bround("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_BONUS = "round_even(" + " + ".join(f"(CASE WHEN contains(lower(coalesce({f}, '')), '{q}') THEN {w} ELSE 0 END)" for f, a, b in (("heading", 0.35, 0.12), ("section_path", 0.25, 0.08), ("text", 0.60, 0.18)) for q, w in (("reglement der", a), ("reglement", b), ("der", b))) + ", 6)"


@query("K06_lexical_bonus", f"SELECT DISTINCT chunk_id, {_BONUS}::DOUBLE AS bonus FROM chunks WHERE {_BONUS} > 0")
def k06(spark, sf_dir):
    c = load(spark, sf_dir, "chunks", "chunk_id", "heading", "section_path", "text")
    return c.withColumn("bonus", search.lexical_bonus("Reglement der", F.col("heading"), F.col("section_path"), F.col("text"))).where("bonus > 0").select("chunk_id", "bonus").distinct()


@query("K07_K08_reranked")
def k07(spark, sf_dir):
    c = chunks(spark, sf_dir, "version_id", "heading", "section_path", "text", "text_hash")
    return search.lexical_search(c, "срок хранения", 20, ["chunk_id"])


@query("K01_K12_search_rows", "SELECT DISTINCT chunk_id, length(concat_ws(chr(10), CASE WHEN length(heading) > 0 THEN heading END, CASE WHEN length(section_path) > 0 AND section_path IS DISTINCT FROM heading THEN section_path END, text)) AS n_chars FROM chunks")
def k01(spark, sf_dir):
    c = load(spark, sf_dir, "chunks", "chunk_id", "heading", "section_path", "text")
    return c.select("chunk_id", F.length(search.embedding_text(F.col("heading"), F.col("section_path"), F.col("text"))).cast("bigint").alias("n_chars")).distinct()


@query("K11_answer_sources")
def k11(spark, sf_dir):
    hits = search.lexical_search(chunks(spark, sf_dir, "version_id", "heading", "section_path", "text", "text_hash"), "отказ", 20, ["chunk_id"])
    return hits.join(chunks(spark, sf_dir, "text"), "chunk_id").select("chunk_id", "version_id", "bonus", truncate(F.col("text"), 120).alias("quote"))
