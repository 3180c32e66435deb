"""Queries of sections L to V: corpus, splits, models, metrics, gates, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from actloom.core.session import cut_lineage
from actloom.core.tables import load
from actloom.operators import corpus, integrity, metrics, ml
from actloom.operators.reporting import long_form
from actloom.plans.diff_queries import annotations
from actloom.plans.registry import query
from actloom.plans.text_queries import chunks, versions

EXAMPLE = ["text", "true_label", "rule_based_label", "source", "document_id", "pair_id"]


def examples(spark, sf_dir, *columns):
    """One row per example; an example always carries the same values in these columns."""
    return load(spark, sf_dir, "predictions", "example_id", *columns).groupBy("example_id").agg(*[F.min(c).alias(c) for c in columns])


def predictions(spark, sf_dir, *columns):
    return load(spark, sf_dir, "predictions", "model", "split_strategy", "example_id", *columns).distinct()


@query("L01_examples", "SELECT example_id, min(true_label) AS true_label, coalesce(length(min(text)), 0) AS n_chars, coalesce(regexp_matches(min(text), '[0-9]'), false)::INT AS has_number FROM predictions GROUP BY 1")
def l01(spark, sf_dir):
    e = examples(spark, sf_dir, "true_label", "text")
    return e.select("example_id", "true_label", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)).cast("int").alias("has_number"))


@query("L02_first_wins_union", """
SELECT k, min(r) AS source_rank FROM (SELECT sha256(text) k, 0 r FROM documents WHERE text IS NOT NULL UNION ALL SELECT sha256(normalized_text), 1 FROM document_versions WHERE normalized_text IS NOT NULL UNION ALL SELECT sha256(text), 2 FROM chunks WHERE text IS NOT NULL) GROUP BY 1""")
def l02(spark, sf_dir):
    hashed = lambda df, c: df.where(F.col(c).isNotNull()).select(F.sha2(c, 256).alias("k"), F.length(c).alias("n"))
    sources = [hashed(load(spark, sf_dir, "documents", "text"), "text"), hashed(load(spark, sf_dir, "document_versions", "normalized_text"), "normalized_text"), hashed(load(spark, sf_dir, "chunks", "text"), "text")]
    return corpus.union_first_wins(sources, "k").select("k", "source_rank")


@query("L03_L04_label_filter", "SELECT coalesce(source, '(none)') AS source, count(DISTINCT example_id) AS n FROM predictions WHERE true_label IN ('critical', 'important', 'informational', 'editorial') GROUP BY 1")
def l03(spark, sf_dir):
    p = load(spark, sf_dir, "predictions", "source", "example_id", "true_label").where(F.col("true_label").isin("critical", "important", "informational", "editorial"))
    return p.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.countDistinct("example_id").alias("n"))


@query("L05_group_split")
def l05(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("doc_type", F.lit("none")).alias("doc_type"))
    return corpus.group_split(d, "source", "doc_type", 0.2)


@query("L06_stratified_split", """
WITH e AS (SELECT example_id, min(true_label) l FROM predictions GROUP BY 1),
r AS (SELECT example_id, (row_number() OVER (PARTITION BY l ORDER BY sha256('42|' || example_id), example_id) - 0.5) / count(*) OVER (PARTITION BY l) s FROM e)
SELECT example_id, CASE WHEN s <= 0.2 THEN 'test' ELSE 'train' END AS split FROM r""")
def l06(spark, sf_dir):
    return corpus.stratified_split(examples(spark, sf_dir, "true_label"), "true_label", "example_id", 0.2).select("example_id", "split")


@query("L10_leakage", """
WITH k AS (SELECT DISTINCT split_strategy, split, pair_id FROM predictions WHERE pair_id IS NOT NULL)
SELECT a.split_strategy, a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM k a JOIN k b ON a.split_strategy = b.split_strategy AND a.pair_id = b.pair_id AND a.split < b.split GROUP BY ALL""")
def l10(spark, sf_dir):
    return corpus.leakage(load(spark, sf_dir, "predictions", "split_strategy", "split", "pair_id"), "split_strategy", "split", "pair_id")


@query("L11_missing_labels", """
WITH s AS (SELECT DISTINCT split_strategy, split, source FROM predictions WHERE source IS NOT NULL),
w AS (SELECT DISTINCT a.split_strategy, b.split, a.source FROM s a JOIN s b USING (split_strategy))
SELECT * FROM w EXCEPT SELECT * FROM s""")
def l11(spark, sf_dir):
    return corpus.missing_labels(load(spark, sf_dir, "predictions", "split_strategy", "split", "source"), "split_strategy", "split", "source")


@query("L12_leaking_features", "SELECT unnest(['importance', 'predicted_label', 'rule_based_label', 'true_label']) AS feature")
def l12(spark, sf_dir):
    names = load(spark, sf_dir, "predictions").columns + load(spark, sf_dir, "annotation").columns
    found = corpus.leaking_features(names, ("label", "importance"))
    return spark.createDataFrame([(n,) for n in found], "feature string")


@query("L13_distributions", "SELECT field, value, count(*) AS n FROM (SELECT unnest(['lang', 'source', 'doc_type']) field, unnest([coalesce(lang, '(null)'), coalesce(source, '(null)'), coalesce(doc_type, '(null)')]) value FROM documents) GROUP BY 1, 2")
def l13(spark, sf_dir):
    return corpus.distributions(load(spark, sf_dir, "documents", "lang", "source", "doc_type"), ["lang", "source", "doc_type"])


@query("L14_profile", "SELECT lang, count(*) AS n, round_even(avg(n_chars), 4) AS mean_chars, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty, min(document_date) AS first_date FROM documents GROUP BY 1")
def l14(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "lang", "n_chars", "text", "document_date")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.min("document_date").alias("first_date"))


@query("L15_leave_one_source_out", """
WITH e AS (SELECT example_id, min(source) s FROM predictions GROUP BY 1)
SELECT example_id, CASE WHEN coalesce(s = 'evaluation_corpus', false) THEN 'test' WHEN ('0x' || substring(sha256('7|' || example_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 THEN 'validation' ELSE 'train' END AS split FROM e""")
def l15(spark, sf_dir):
    return corpus.leave_one_out(examples(spark, sf_dir, "source"), "source", "evaluation_corpus", "example_id", 7, 0.1).select("example_id", "split")


@query("M01_meta_features", "SELECT example_id, length(lower(coalesce(t, '')))::DOUBLE AS f_chars, " + ", ".join(f"regexp_matches(lower(coalesce(t, '')), '{p}')::INT::DOUBLE AS {n}" for n, p in ml.FLAGS.items()) + " FROM (SELECT example_id, min(text) t FROM predictions GROUP BY 1)")
def m01(spark, sf_dir):
    return ml.meta_features(examples(spark, sf_dir, "text"), "text").select("example_id", "f_chars", *ml.FLAGS)


def trained(spark, sf_dir, kind="logistic"):
    """Trained on the training rows of one strategy, applied to its test rows."""
    e = examples(spark, sf_dir, "text", "true_label", "rule_based_label")
    s = load(spark, sf_dir, "predictions", "example_id", "split_strategy", "split").where("split_strategy = 'group_split_document_id'").select("example_id", "split").distinct()
    e = cut_lineage(e.join(s, "example_id"))
    return ml.fit(e.where("split = 'train'"), "text", "true_label", kind), e.where("split = 'test'")


@query("M02_M05_model_predictions")
def m02(spark, sf_dir):
    model, test = trained(spark, sf_dir)
    return ml.predict(model, test, "text", "true_label").select("example_id", "true_label", "ml_label", F.bround("ml_probability", 4).alias("ml_probability"))


@query("M03_M11_model_suite")
def m03(spark, sf_dir):
    out = None
    for kind in ("logistic", "forest", "complement_nb"):
        model, test = trained(spark, sf_dir, kind)
        cells = metrics.confusion(ml.predict(model, test, "text", "true_label").withColumn("model", F.lit(kind)), ["model"], "true_label", "ml_label")
        one = metrics.summary(metrics.per_class(cells, ["model"], "true_label", "ml_label"), ["model"])
        out = one if out is None else out.unionByName(one)
    return out


@query("M06_importances")
def m06(spark, sf_dir):
    return spark.createDataFrame(ml.importances(trained(spark, sf_dir)[0], 20), "label string, feature int, weight double")


@query("M08_hybrid_decision", """
SELECT DISTINCT model, split_strategy, example_id, CASE WHEN rule_based_label = 'critical' THEN rule_based_label WHEN rule_based_label = predicted_label THEN rule_based_label
  WHEN predicted_label IN ('critical', 'important') AND rule_based_label NOT IN ('critical', 'important') AND coalesce(probability, 0) >= 0.75 THEN predicted_label
  WHEN rule_based_label IN ('critical', 'important') THEN rule_based_label WHEN coalesce(probability, 0) >= 0.6 THEN predicted_label ELSE rule_based_label END AS hybrid FROM predictions""")
def m08(spark, sf_dir):
    p = predictions(spark, sf_dir, "rule_based_label", "predicted_label", "probability")
    return p.select("model", "split_strategy", "example_id", ml.hybrid(F.col("rule_based_label"), F.col("predicted_label"), F.col("probability")).alias("hybrid")).distinct()


_HIGH = "IN ('critical', 'important')"


@query("M09_error_rows", f"SELECT DISTINCT model, split_strategy, example_id, CASE WHEN true_label {_HIGH} AND predicted_label NOT {_HIGH} THEN 'false_negative' WHEN true_label NOT {_HIGH} AND predicted_label {_HIGH} THEN 'false_positive' ELSE 'misclassification' END AS error FROM predictions WHERE true_label <> predicted_label")
def m09(spark, sf_dir):
    p = predictions(spark, sf_dir, "true_label", "predicted_label").where("true_label <> predicted_label")
    high = ("critical", "important")
    t, g = F.col("true_label").isin(*high), F.col("predicted_label").isin(*high)
    return p.select("model", "split_strategy", "example_id", F.when(t & ~g, "false_negative").when(~t & g, "false_positive").otherwise("misclassification").alias("error")).distinct()


@query("M12_disagreements", "SELECT model, count(*) FILTER (WHERE predicted_label <> rule_based_label) AS n_disagree, count(*) AS n FROM (SELECT DISTINCT model, split_strategy, example_id, predicted_label, rule_based_label FROM predictions) GROUP BY 1")
def m12(spark, sf_dir):
    return predictions(spark, sf_dir, "predicted_label", "rule_based_label").groupBy("model").agg(F.count_if(F.col("predicted_label") != F.col("rule_based_label")).alias("n_disagree"), F.count(F.lit(1)).alias("n"))


_CELLS = "c AS (SELECT model, split_strategy, true_label t, predicted_label p, count(*) n FROM (SELECT DISTINCT model, split_strategy, example_id, true_label, predicted_label FROM predictions) WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL)"
_CLASSES = _CELLS + """, l AS (SELECT DISTINCT model, split_strategy, t label FROM c UNION SELECT DISTINCT model, split_strategy, p FROM c),
k AS (SELECT model, split_strategy, label, coalesce(sum(n) FILTER (WHERE t = label), 0)::BIGINT support, coalesce(sum(n) FILTER (WHERE p = label), 0)::BIGINT predicted, coalesce(sum(n) FILTER (WHERE t = label AND p = label), 0)::BIGINT hits FROM l JOIN c USING (model, split_strategy) GROUP BY ALL),
r AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END pr, CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END re FROM k),
m AS (SELECT model, split_strategy, label, support, predicted, hits, round_even(pr, 4) AS precision, round_even(re, 4) AS recall, round_even(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM r)"""


def cells(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir, "true_label", "predicted_label"), ["model", "split_strategy"], "true_label", "predicted_label")


def classes(spark, sf_dir):
    return metrics.per_class(cells(spark, sf_dir), ["model", "split_strategy"], "true_label", "predicted_label")


@query("N01_confusion", f"WITH {_CELLS} SELECT model, split_strategy, t AS true_label, p AS predicted_label, n FROM c")
def n01(spark, sf_dir):
    return cells(spark, sf_dir)


@query("N02_per_class", f"WITH {_CLASSES} SELECT * FROM m")
def n02(spark, sf_dir):
    return classes(spark, sf_dir)


@query("N03_binary", f"""
WITH p AS (SELECT DISTINCT model, example_id, split_strategy, true_label, predicted_label FROM predictions),
b AS (SELECT model, count(*) FILTER (WHERE t AND q) tp, count(*) FILTER (WHERE NOT t AND q) fp, count(*) FILTER (WHERE t AND NOT q) fn, count(*) FILTER (WHERE NOT t AND NOT q) tn FROM (SELECT model, coalesce(true_label {_HIGH}, false) t, coalesce(predicted_label {_HIGH}, false) q FROM p) GROUP BY 1)
SELECT *, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS recall, round_even(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 4) AS f1 FROM b""")
def n03(spark, sf_dir):
    high = ("critical", "important")
    return metrics.binary(predictions(spark, sf_dir, "true_label", "predicted_label"), ["model"], F.col("true_label").isin(*high), F.col("predicted_label").isin(*high))


@query("N04_summary", f"WITH {_CLASSES} SELECT model, split_strategy, round_even(sum(hits) / sum(support)::DOUBLE, 4) AS accuracy, round_even(avg(f1), 12) AS macro_f1, round_even(sum(f1 * support) / sum(support)::DOUBLE, 12) AS weighted_f1, sum(support)::BIGINT AS n FROM m GROUP BY 1, 2")
def n04(spark, sf_dir):
    return metrics.summary(classes(spark, sf_dir), ["model", "split_strategy"])


@query("N05_roc_auc", f"""
WITH p AS (SELECT DISTINCT model, example_id, split_strategy, probability s, coalesce(true_label {_HIGH}, false) t FROM predictions WHERE probability IS NOT NULL),
c AS (SELECT model, s, count(*) FILTER (WHERE t) p, count(*) FILTER (WHERE NOT t) n FROM p GROUP BY 1, 2),
w AS (SELECT model, p, n, p * (coalesce(sum(n) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) v FROM c)
SELECT model, round_even(CASE WHEN sum(p) * sum(n) > 0 THEN sum(v) / (sum(p) * sum(n)) ELSE 0 END, 6) AS auc FROM w GROUP BY 1""")
def n05(spark, sf_dir):
    p = predictions(spark, sf_dir, "probability", F.coalesce(F.col("true_label").isin("critical", "important"), F.lit(False)).alias("t"))
    return metrics.roc_auc(p, ["model"], F.col("t"), "probability")


@query("N06_boundary_matching")
def n06(spark, sf_dir):
    """Annotated fragments against the chunks of the same version: here each chunk's heading as what is expected."""
    c = chunks(spark, sf_dir, "version_id", "chunk_index", "heading", "text")
    expected = c.where("length(heading) > 0").select("version_id", F.col("chunk_index").alias("expected_id"), F.col("heading").alias("text"))
    return metrics.contained_matches(expected, c.select("version_id", F.col("chunk_index").alias("found_id"), "text"), "version_id")


@query("N07_N09_micro_macro", f"""
WITH {_CLASSES}, x AS (SELECT model, hits tp, predicted - hits fp, support - hits fn FROM m),
s AS (SELECT model, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, round_even(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END), 4) macro_precision, round_even(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END), 4) macro_recall FROM x GROUP BY 1)
SELECT *, round_even(tp / (tp + fp)::DOUBLE, 4) AS micro_precision, round_even(tp / (tp + fn)::DOUBLE, 4) AS micro_recall, round_even(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS micro_f1 FROM s""")
def n07(spark, sf_dir):
    c = classes(spark, sf_dir)
    return metrics.micro_macro(c.select("model", F.col("hits").alias("tp"), (F.col("predicted") - F.col("hits")).alias("fp"), (F.col("support") - F.col("hits")).alias("fn")), ["model"])


@query("N10_topic_coverage")
def n10(spark, sf_dir):
    from actloom.functions.text import content_words

    a = annotations(spark, sf_dir, "description", "new_text", "old_text")
    return a.select("annotation_id", metrics.topic_covered(content_words(F.coalesce("description", F.lit("")), ("и", "в")), F.coalesce("new_text", "old_text")).alias("covered"))


@query("N15_metric_long_table", f"WITH {_CLASSES}, s AS (SELECT model, split_strategy, round_even(sum(hits) / sum(support)::DOUBLE, 4) accuracy, round_even(avg(f1), 12) macro_f1 FROM m GROUP BY 1, 2) SELECT model, split_strategy, unnest(['accuracy', 'macro_f1']) AS metric, unnest([accuracy, macro_f1]) AS score FROM s")
def n15(spark, sf_dir):
    s = metrics.summary(classes(spark, sf_dir), ["model", "split_strategy"])
    return long_form(s, ["model", "split_strategy"], ["accuracy", "macro_f1"]).select("model", "split_strategy", F.col("field").alias("metric"), F.col("value").cast("double").alias("score"))


@query("N17_corpus_audit", "SELECT pair_id, count(DISTINCT annotation_id) AS n_changes, count(DISTINCT annotation_id) FILTER (WHERE old_text IS NULL OR new_text IS NULL) AS n_one_sided, count(DISTINCT language) AS n_languages FROM annotation GROUP BY 1")
def n17(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "pair_id", "annotation_id", "old_text", "new_text", "language")
    one = F.when(F.col("old_text").isNull() | F.col("new_text").isNull(), F.col("annotation_id"))
    return a.groupBy("pair_id").agg(F.countDistinct("annotation_id").alias("n_changes"), F.countDistinct(one).alias("n_one_sided"), F.countDistinct("language").alias("n_languages"))


@query("N18_corpus_validation", "SELECT DISTINCT annotation_id, CASE WHEN pair_id IS NULL THEN 'no pair' WHEN lower(change_type) NOT IN ('added', 'removed', 'modified', 'moved') THEN 'unknown type' WHEN lower(change_type) = 'added' AND old_text IS NOT NULL THEN 'added with old text' WHEN lower(change_type) = 'removed' AND new_text IS NOT NULL THEN 'removed with new text' ELSE 'ok' END AS verdict FROM annotation")
def n18(spark, sf_dir):
    kind = F.lower("change_type")
    v = F.when(F.col("pair_id").isNull(), "no pair").when(~kind.isin("added", "removed", "modified", "moved"), "unknown type").when((kind == "added") & F.col("old_text").isNotNull(), "added with old text").when((kind == "removed") & F.col("new_text").isNotNull(), "removed with new text").otherwise("ok")
    return annotations(spark, sf_dir, "pair_id", "change_type", "old_text", "new_text").select("annotation_id", v.alias("verdict"))


_P3 = "CASE {0} WHEN 'critical' THEN 3 WHEN 'important' THEN 2 ELSE 1 END"


@query("O02_worst_label", f"SELECT pair_id, max_by(importance, ({_P3.format('importance')}, -annotation_id)) AS label FROM (SELECT DISTINCT pair_id, annotation_id, importance FROM annotation WHERE importance IS NOT NULL) GROUP BY 1")
def o02(spark, sf_dir):
    prio = F.when(F.col("importance") == "critical", 3).when(F.col("importance") == "important", 2).otherwise(1)
    return annotations(spark, sf_dir, "pair_id", "importance").where("importance is not null").groupBy("pair_id").agg(F.max_by("importance", F.struct(prio, -F.col("annotation_id"))).alias("label"))


@query("O04_chunking_stats", "SELECT version_id, count(*) AS n, count(*) FILTER (WHERE f = 'fallback_block') AS n_fallback, round_even(count(*) FILTER (WHERE f = 'fallback_block') / count(*)::DOUBLE, 4) AS fallback_ratio FROM (SELECT DISTINCT chunk_id, version_id, coalesce(nullif(lower(trim(fragment_type, ' ' || chr(9))), ''), 'fallback_block') f FROM chunks) GROUP BY 1")
def o04(spark, sf_dir):
    from actloom.functions.text import safe_divide, strip

    kind = F.lower(strip(F.coalesce("fragment_type", F.lit(""))))
    c = chunks(spark, sf_dir, "version_id", "fragment_type").withColumn("f", F.when(kind == "", "fallback_block").otherwise(kind))
    g = c.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") == "fallback_block").alias("n_fallback"))
    return g.withColumn("fallback_ratio", safe_divide(F.col("n_fallback"), F.col("n"), 4))


@query("O05_gate", f"WITH {_CLASSES} SELECT model, round_even(sum(hits) / sum(support)::DOUBLE, 4) AS accuracy, round_even(sum(hits) / sum(support)::DOUBLE, 4) >= 0.85 AS passed FROM m GROUP BY 1")
def o05(spark, sf_dir):
    s = metrics.summary(classes(spark, sf_dir), ["model"])
    return s.select("model", "accuracy", metrics.gate(F.col("accuracy"), 0.85).alias("passed"))


@query("V01_V14_violations", """
WITH v AS (SELECT DISTINCT version_id, document_id, version_number, content_hash FROM document_versions), c AS (SELECT DISTINCT chunk_id, version_id, chunk_index FROM chunks)
SELECT 'V01 version number' AS rule, document_id || '/' || version_number AS key, count(*) || ' rows' AS detail FROM v GROUP BY document_id, version_number HAVING count(*) > 1
UNION ALL SELECT 'V02 chunk index', version_id || '/' || chunk_index, count(*) || ' rows' FROM c WHERE chunk_index IS NOT NULL GROUP BY version_id, chunk_index HAVING count(*) > 1
UNION ALL SELECT 'V03 content twice', document_id || '/' || content_hash, count(*) || ' rows' FROM v WHERE content_hash IS NOT NULL GROUP BY document_id, content_hash HAVING count(*) > 1
UNION ALL SELECT 'V06 probability', example_id, probability::VARCHAR FROM predictions WHERE probability < 0 OR probability > 1
UNION ALL SELECT 'V14 lost chunk', chunk_id::VARCHAR, version_id::VARCHAR FROM c WHERE version_id NOT IN (SELECT version_id FROM v)""")
def v01(spark, sf_dir):
    v = versions(spark, sf_dir, "document_id", "version_number", "content_hash")
    c = chunks(spark, sf_dir, "version_id", "chunk_index")
    p = load(spark, sf_dir, "predictions", "example_id", "probability")
    return integrity.all_of(
        integrity.duplicates(v, "V01 version number", ["document_id", "version_number"]),
        integrity.duplicates(c, "V02 chunk index", ["version_id", "chunk_index"]),
        integrity.duplicates(v, "V03 content twice", ["document_id", "content_hash"]),
        integrity.broken(p, "V06 probability", "example_id", (F.col("probability") < 0) | (F.col("probability") > 1), F.col("probability")),
        integrity.orphans(c, "V14 lost chunk", "chunk_id", v, "version_id"),
    )


@query("S03_current_version", "SELECT document_id, max_by(version_id, (version_number, version_id)) AS current_version_id, max(effective_date) AS last_date FROM document_versions GROUP BY 1")
def s03(spark, sf_dir):
    v = versions(spark, sf_dir, "document_id", "version_number", "effective_date")
    return v.groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("current_version_id"), F.max("effective_date").alias("last_date"))


@query("S14_diagnostics", "SELECT coalesce(language, '(none)') AS language, CASE WHEN f = 0 THEN 'missing' WHEN f < n THEN 'partial' ELSE 'available' END AS status FROM (SELECT language, count(*) n, count(normalized_text) f FROM document_versions GROUP BY 1)")
def s14(spark, sf_dir):
    g = load(spark, sf_dir, "document_versions", "language", "normalized_text").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("normalized_text").alias("f"))
    return g.select(F.coalesce("language", F.lit("(none)")).alias("language"), F.when(F.col("f") == 0, "missing").when(F.col("f") < F.col("n"), "partial").otherwise("available").alias("status"))


@query("A11_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'updated' WHEN doc_id % 3 = 0 THEN 'created' ELSE 'kept' END AS change FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def a11(spark, sf_dir):
    from actloom.sources.files import upsert

    d = load(spark, sf_dir, "documents", "doc_id", "title")
    return upsert(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), "doc_id").select("doc_id", "change")


@query("A09_act_xml")
def a09(spark, sf_dir):
    from actloom.sources.files import act_xml

    return act_xml(load(spark, sf_dir, "documents", "doc_id", "title", "document_date", "text"), ["doc_id", "title", "document_date"], "text")


@query("T01_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t01(spark, sf_dir):
    """The batch form of the streamed counts."""
    from actloom.streaming.versions import windowed_counts

    return windowed_counts(load(spark, sf_dir, "events", "ts", "event_type"), "ts", "event_type")
