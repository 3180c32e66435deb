"""Further queries: synthetic rows, caches, refreshes, funnels, roll-ups, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from actloom.core.tables import load
from actloom.functions import markers, text
from actloom.operators import corpus, matching, metrics, search, topk
from actloom.plans.corpus_queries import examples, predictions
from actloom.plans.diff_queries import EDITS, V, annotations, edits, pairs_of
from actloom.plans.registry import query
from actloom.plans.report_queries import _DOT, _NORM
from actloom.plans.text_queries import _LINES, chunks, versions

FAMILIES = [("deadline", ["30 days", "10 days"]), ("fee", ["EUR 5", "EUR 7", "EUR 9"]), ("refusal", [])]


@query("A21_synthetic_rows", "SELECT * FROM (VALUES ('deadline', 1, '30 days'), ('deadline', 2, '10 days'), ('fee', 1, 'EUR 5'), ('fee', 2, 'EUR 7'), ('fee', 3, 'EUR 9')) t(family, variant, value)")
def a21(spark, sf_dir):
    df = spark.createDataFrame(FAMILIES, "family string, variants array<string>")
    return df.select("family", F.posexplode("variants").alias("pos", "value")).select("family", (F.col("pos") + 1).alias("variant"), "value")


@query("A24_previews", "SELECT doc_id, substring(text, 1, 40) AS preview FROM documents WHERE text IS NOT NULL")
def a24(spark, sf_dir):
    return load(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.substring("text", 1, 40).alias("preview"))


@query("B09_heading_labels", "SELECT DISTINCT chunk_id, trim(upper(substring(kind, 1, 1)) || lower(substring(kind, 2)) || ' ' || raw_label) || CASE WHEN length(trim(coalesce(heading, ''))) > 0 THEN ': ' || trim(heading) ELSE '' END AS label FROM (SELECT *, trim(fragment_type, ' ' || chr(9)) kind FROM chunks) WHERE raw_label IS NOT NULL AND kind <> ''")
def b09(spark, sf_dir):
    c = chunks(spark, sf_dir, "fragment_type", "raw_label", "heading").where("raw_label is not null").where(F.length(text.strip(F.col("fragment_type"))) > 0)
    return c.select("chunk_id", text.heading_label(F.col("fragment_type"), F.col("raw_label"), F.coalesce("heading", F.lit(""))).alias("label"))


@query("B28_label_accessors", "SELECT DISTINCT model, split_strategy, example_id, coalesce(CASE WHEN length(trim(predicted_label)) > 0 THEN predicted_label END, CASE WHEN length(trim(rule_based_label)) > 0 THEN rule_based_label END, 'not_evaluated') AS label FROM predictions")
def b28(spark, sf_dir):
    p = predictions(spark, sf_dir, "predicted_label", "rule_based_label")
    return p.select("model", "split_strategy", "example_id", F.coalesce(text.first_filled(F.col("predicted_label"), F.col("rule_based_label")), F.lit("not_evaluated")).alias("label")).distinct()


@query("B35_structural_lines", _LINES + "SELECT version_id, count(*) FILTER (WHERE kind NOT IN ('body', 'blank')) AS n_structural, count(*) AS n_lines FROM k GROUP BY 1")
def b35(spark, sf_dir):
    v = versions(spark, sf_dir, "normalized_text").where("normalized_text is not null")
    lines = v.select("version_id", F.explode(F.split("normalized_text", "\n")).alias("line"))
    kind = markers.line_kind(text.strip(F.col("line")))
    return lines.groupBy("version_id").agg(F.count_if(~kind.isin("body", "blank")).alias("n_structural"), F.count(F.lit(1)).alias("n_lines"))


@query("C13_rebuilt_chunks")
def c13(spark, sf_dir):
    """Chunks as they are made anew that the stored table has under another hash, by version."""
    from actloom.operators.chunking import chunk_documents

    made = chunk_documents(versions(spark, sf_dir, "normalized_text"), ["version_id"], "normalized_text").select("version_id", F.substring("text_hash", 1, 16).alias("text_hash"))
    stored = chunks(spark, sf_dir, "version_id", "text_hash").select("version_id", "text_hash")
    return made.join(stored, ["version_id", "text_hash"], "left_anti").groupBy("version_id").agg(F.count(F.lit(1)).alias("n_changed"))


@query("D18_identical_content", V + ", h AS (SELECT DISTINCT version_id, content_hash FROM document_versions WHERE content_hash IS NOT NULL) SELECT document_id, from_id, to_id FROM pairs JOIN h a ON a.version_id = from_id JOIN h b ON b.version_id = to_id WHERE a.content_hash = b.content_hash")
def d18(spark, sf_dir):
    h = versions(spark, sf_dir, "content_hash").where("content_hash is not null")
    p = pairs_of(spark, sf_dir).join(h.select(F.col("version_id").alias("from_id"), F.col("content_hash").alias("h0")), "from_id").join(h.select(F.col("version_id").alias("to_id"), F.col("content_hash").alias("h1")), "to_id")
    return p.where("h0 = h1").select("document_id", "from_id", "to_id")


@query("D21_rank_fallback", """
WITH l AS (SELECT DISTINCT pair_id, change_id, annotation_id FROM annotation), r AS (SELECT pair_id, change_id, min(example_id) example_id FROM predictions WHERE pair_id IS NOT NULL AND change_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT l.pair_id, annotation_id, example_id FROM l LEFT JOIN r USING (pair_id, change_id)),
ol AS (SELECT pair_id, annotation_id, row_number() OVER (PARTITION BY pair_id ORDER BY annotation_id) k FROM f WHERE example_id IS NULL),
o AS (SELECT pair_id, example_id, row_number() OVER (PARTITION BY pair_id ORDER BY example_id) k FROM (SELECT DISTINCT pair_id, example_id FROM r) x WHERE (pair_id, example_id) NOT IN (SELECT (pair_id, example_id) FROM f WHERE example_id IS NOT NULL))
SELECT pair_id, annotation_id, example_id, 'id' AS by FROM f WHERE example_id IS NOT NULL UNION ALL SELECT pair_id, annotation_id, example_id, CASE WHEN example_id IS NULL THEN 'none' ELSE 'rank' END FROM ol LEFT JOIN o USING (pair_id, k)""")
def d21(spark, sf_dir):
    left = annotations(spark, sf_dir, "pair_id", "change_id")
    right = load(spark, sf_dir, "predictions", "pair_id", "change_id", "example_id").where("pair_id is not null and change_id is not null").groupBy("pair_id", "change_id").agg(F.min("example_id").alias("example_id"))
    return topk.rank_fallback(left, right, ["pair_id"], "change_id", "annotation_id", "example_id")


@query("E20_moderation_stats", "WITH p AS (SELECT DISTINCT change_id FROM predictions WHERE change_id IS NOT NULL), a AS (SELECT DISTINCT annotation_id, change_id FROM annotation) SELECT count(*) AS n_total, count(p.change_id) AS n_moderated, count(*) - count(p.change_id) AS n_automatic FROM a LEFT JOIN p USING (change_id)")
def e20(spark, sf_dir):
    p = load(spark, sf_dir, "predictions", "change_id").where("change_id is not null").distinct().withColumn("_m", F.lit(True))
    a = annotations(spark, sf_dir, "change_id").join(p, "change_id", "left")
    return a.agg(F.count(F.lit(1)).alias("n_total"), F.count("_m").alias("n_moderated"), F.count_if(F.col("_m").isNull()).alias("n_automatic"))


@query("F13_fenced_json", "SELECT event_id, json_extract_string(regexp_extract('```json' || chr(10) || props || chr(10) || '```', '(\\{.*\\})', 1), '$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def f13(spark, sf_dir):
    """What a model answers: JSON inside fences, taken from the outermost braces."""
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    body = F.regexp_extract(raw, r"(\{.*\})", 1)
    return load(spark, sf_dir, "events", "event_id", "props").where("props is not null").select("event_id", F.get_json_object(body, "$.k").cast("bigint").alias("k"))


@query("G07_topics", "WITH d AS (SELECT DISTINCT pair_id, importance FROM annotation WHERE importance IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY importance) k FROM d) SELECT pair_id, string_agg(importance, ', ' ORDER BY k) AS topics FROM r WHERE k <= 3 GROUP BY 1")
def g07(spark, sf_dir):
    d = load(spark, sf_dir, "annotation", "pair_id", "importance").where("importance is not null").distinct()
    t = topk.top(d, ["pair_id"], ["importance"], 3, "k")
    return t.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_list("importance")), ", ").alias("topics"))


@query("I01_answer_resolution", "SELECT l_orderkey, l_linenumber, coalesce('supplier ' || s_suppkey, 'part ' || p_partkey, 'none') AS chosen FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey < 10 LEFT JOIN part ON p_partkey = l_partkey")
def i01(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("a"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("b"))
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return lines.join(s, "l_suppkey", "left").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b", F.lit("none")).alias("chosen"))


@query("I11_cache_misses", "WITH k AS (SELECT doc_id, sha256(concat_ws('|', coalesce(title, ''), coalesce(source, ''))) h FROM documents), c AS (SELECT DISTINCT h FROM k WHERE doc_id % 2 = 0) SELECT doc_id FROM k WHERE h NOT IN (SELECT h FROM c)")
def i11(spark, sf_dir):
    """Rows whose content key is not among those worked out before: here those of even ids."""
    key = F.sha2(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit(""))), 256)
    k = load(spark, sf_dir, "documents", "doc_id", "title", "source").select("doc_id", key.alias("h"))
    return k.join(k.where("doc_id % 2 = 0").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("J02_latest_examples", "WITH e AS (SELECT change_id, example_id, max(created_at) c FROM predictions WHERE change_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY c DESC, example_id) rank FROM e) SELECT change_id, example_id, rank FROM r WHERE rank <= 3")
def j02(spark, sf_dir):
    e = load(spark, sf_dir, "predictions", "change_id", "example_id", "created_at").where("change_id is not null").groupBy("change_id", "example_id").agg(F.max("created_at").alias("c"))
    return topk.top(e, ["change_id"], [F.desc("c"), "example_id"], 3).select("change_id", "example_id", F.col("rank").cast("bigint").alias("rank"))


@query("K09_index_refresh", "WITH v AS (SELECT DISTINCT version_id, document_id, version_number FROM document_versions), l AS (SELECT document_id, max_by(version_id, (version_number, version_id)) version_id FROM v GROUP BY 1), c AS (SELECT DISTINCT chunk_id, version_id FROM chunks) SELECT l.document_id, count(*) AS n_rows FROM c JOIN l USING (version_id) GROUP BY 1")
def k09(spark, sf_dir):
    """Rows of the index after a refresh: the chunks of the newest version of each document."""
    newest = versions(spark, sf_dir, "document_id", "version_number").groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("version_id"))
    return chunks(spark, sf_dir, "version_id").join(newest, "version_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("K10_session_search", f"WITH q AS (SELECT embedding q, {_NORM.format('embedding')} nq FROM embeddings WHERE vec_id = 0) SELECT vec_id, round_even(1 - round({_DOT} / (nq * {_NORM.format('embedding')}), 12), 6) AS distance FROM embeddings, q WHERE vec_id <> 0 ORDER BY round({_DOT} / (nq * {_NORM.format('embedding')}), 12) DESC, vec_id LIMIT 10")
def k10(spark, sf_dir):
    """One query vector, in the JVM: cosine distance, the ten nearest."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    c = F.round(search.cosine(F.col("embedding"), F.col("q")), 12)
    return e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", c.alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.bround(1 - F.col("c"), 6).alias("distance"))


@query("K10_session_searches")
def k10_all(spark, sf_dir):
    """K10_session_search for every row whose id is divisible by 20: cosine distance, the ten nearest of each."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = search.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.bround(1 - F.col("score"), 6).alias("distance"))


@query("L07_label_minimums", """
WITH e AS (SELECT example_id, min(true_label) l, min(split) s FROM predictions WHERE split_strategy = 'random_stratified_split' GROUP BY 1), h AS (SELECT l, count(*) FILTER (WHERE s = 'test') h FROM e GROUP BY 1),
r AS (SELECT e.*, h, row_number() OVER (PARTITION BY e.l, s ORDER BY example_id) k FROM e JOIN h USING (l))
SELECT example_id, CASE WHEN s = 'train' AND k <= 20 - h THEN 'test' ELSE s END AS split FROM r""")
def l07(spark, sf_dir):
    p = load(spark, sf_dir, "predictions", "example_id", "true_label", "split", "split_strategy").where("split_strategy = 'random_stratified_split'")
    e = p.groupBy("example_id").agg(F.min("true_label").alias("true_label"), F.min("split").alias("split"))
    return corpus.label_minimums(e, "true_label", "example_id", "test", "train", 20).select("example_id", "split")


@query("N08_change_matching")
def n08(spark, sf_dir):
    """Annotated changes against each other's wording within a pair: old texts expected, new texts found."""
    a = annotations(spark, sf_dir, "pair_id", "old_text", "new_text").where("pair_id is not null")
    expected = a.where("old_text is not null").select("pair_id", F.col("annotation_id").alias("expected_id"), F.col("old_text").alias("text"))
    found = a.where("new_text is not null").select("pair_id", F.col("annotation_id").alias("found_id"), F.col("new_text").alias("text"))
    return metrics.similar_matches(expected, found, "pair_id")


@query("N14_funnel", "WITH a AS (SELECT DISTINCT change_id FROM annotation WHERE importance IN ('critical', 'important')), p AS (SELECT change_id, bool_or(split = 'test') t, bool_or(predicted_label = true_label) r FROM predictions WHERE change_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_important, count(t) AS n_with_example, count(*) FILTER (WHERE t) AS n_tested, count(*) FILTER (WHERE t AND r) AS n_right FROM a LEFT JOIN p USING (change_id)")
def n14(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "change_id", "importance").where(F.col("importance").isin("critical", "important")).select("change_id").distinct()
    p = load(spark, sf_dir, "predictions", "change_id", "split", "predicted_label", "true_label").where("change_id is not null").groupBy("change_id").agg(F.bool_or(F.col("split") == "test").alias("t"), F.bool_or(F.col("predicted_label") == F.col("true_label")).alias("r"))
    return a.join(p, "change_id", "left").agg(F.count(F.lit(1)).alias("n_important"), F.count("t").alias("n_with_example"), F.count_if("t").alias("n_tested"), F.count_if(F.col("t") & F.col("r")).alias("n_right"))


@query("N19_S27_rule_errors", "SELECT rule_based_label, true_label, count(*) AS n FROM (SELECT example_id, min(rule_based_label) rule_based_label, min(true_label) true_label FROM predictions GROUP BY 1) WHERE rule_based_label <> true_label GROUP BY 1, 2")
def n19(spark, sf_dir):
    e = examples(spark, sf_dir, "rule_based_label", "true_label").where("rule_based_label <> true_label")
    return e.groupBy("rule_based_label", "true_label").agg(F.count(F.lit(1)).alias("n"))


_EVERY = EDITS + """, every AS (SELECT pair_id, operation FROM edits UNION ALL SELECT pair_id, 'unchanged' FROM same),
g AS (SELECT pair_id, count(*) FILTER (WHERE operation <> 'unchanged') n_changes, count(*) n FROM every GROUP BY 1)"""


@query("O06_pair_stats", _EVERY + "SELECT g.pair_id, document_id, n_changes, round_even(n_changes / n::DOUBLE, 4) AS change_rate FROM g JOIN pairs ON pairs.from_id = g.pair_id")
def o06(spark, sf_dir):
    g = edits(spark, sf_dir).groupBy("pair_id").agg(F.count_if(F.col("operation") != "unchanged").alias("n_changes"), F.count(F.lit(1)).alias("n"))
    return g.join(pairs_of(spark, sf_dir).select("pair_id", "document_id"), "pair_id").select("pair_id", "document_id", "n_changes", text.safe_divide(F.col("n_changes"), F.col("n"), 4).alias("change_rate"))


@query("O07_suite_rollup", _EVERY + "SELECT count(*) AS n_pairs, count(*) FILTER (WHERE n_changes > 0) AS n_changed, sum(n_changes)::BIGINT AS n_changes, max(n_changes) AS most_changes FROM g")
def o07(spark, sf_dir):
    c = matching.diff_counts(edits(spark, sf_dir)).withColumn("n", F.expr("n_added + n_removed + n_modified"))
    return c.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("n") > 0).alias("n_changed"), F.sum("n").alias("n_changes"), F.max("n").alias("most_changes"))


@query("S01_ingest", """
WITH v AS (SELECT DISTINCT version_id, document_id, version_number, normalized_text, content_hash FROM document_versions), d AS (SELECT document_id, max(version_number) last FROM v GROUP BY 1),
s AS (SELECT document_id, normalized_text t, sha256(normalized_text) h FROM v WHERE version_number = 1)
SELECT s.document_id, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN EXISTS (SELECT 1 FROM v WHERE v.document_id = s.document_id AND v.content_hash = s.h) THEN 'duplicate' ELSE 'accepted' END AS verdict, last + 1 AS next_number FROM s JOIN d USING (document_id)""")
def s01(spark, sf_dir):
    """First versions delivered again: empty and duplicate texts are turned away, others get the next number."""
    v = versions(spark, sf_dir, "document_id", "version_number", "normalized_text", "content_hash")
    new = v.where("version_number = 1").select("document_id", "normalized_text", F.sha2("normalized_text", 256).alias("content_hash"))
    known = v.where("content_hash is not null").select("document_id", "content_hash").distinct().withColumn("_d", F.lit(True))
    last = v.groupBy("document_id").agg(F.max("version_number").alias("last"))
    verdict = F.when(F.coalesce("normalized_text", F.lit("")) == "", "empty").when(F.col("_d"), "duplicate").otherwise("accepted")
    return new.join(known, ["document_id", "content_hash"], "left").join(last, "document_id").select("document_id", verdict.alias("verdict"), (F.col("last") + 1).alias("next_number"))


@query("S04_delete_and_refresh", "WITH v AS (SELECT DISTINCT version_id, document_id, version_number FROM document_versions WHERE version_id % 7 <> 0) SELECT document_id, max_by(version_id, (version_number, version_id)) AS current_version_id FROM v GROUP BY 1")
def s04(spark, sf_dir):
    """The current version of each document after versions are deleted, here every seventh."""
    v = versions(spark, sf_dir, "document_id", "version_number")
    gone = v.where("version_id % 7 = 0").select("version_id")
    return v.join(gone, "version_id", "left_anti").groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("current_version_id"))
