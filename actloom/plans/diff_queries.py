"""Queries of sections D to H: version pairs, diffs, classification, entities, summaries, questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from actloom.core.tables import load
from actloom.functions import entities, rules, text
from actloom.operators import matching, topk
from actloom.operators.reporting import overlay
from actloom.plans.registry import query
from actloom.plans.text_queries import chunks, versions

V = """
WITH v AS (SELECT DISTINCT version_id, document_id, version_number FROM document_versions),
pairs AS (SELECT document_id, from_id, to_id, row_number() OVER (ORDER BY from_id) pair_id FROM
  (SELECT document_id, version_id from_id, lead(version_id) OVER (PARTITION BY document_id ORDER BY version_number, version_id) to_id FROM v) WHERE to_id IS NOT NULL)
"""
CH = """,
ch AS (SELECT DISTINCT chunk_id, version_id, chunk_index, fragment_type, canonical_label, path_key, heading, section_path, text, text_hash FROM chunks),
o0 AS (SELECT from_id pair_id, ch.* FROM pairs JOIN ch ON version_id = from_id),
n0 AS (SELECT from_id pair_id, ch.* FROM pairs JOIN ch ON version_id = to_id)
"""


def _anchor_sql(name: str) -> str:
    parts = {"path_key": ["path_key"], "canonical_label": ["canonical_label"], "section_path": ["heading", "section_path"], "same_index": ["chunk_index::VARCHAR"]}[name]
    kind = [] if name == "same_index" else ["coalesce(fragment_type, '')"]  # a place is one whatever the type
    return f"CASE WHEN {' AND '.join(f'length({p}) > 0' for p in parts)} THEN concat_ws('|', {', '.join([*kind, *parts])}) END"


def _passes(old: str, new: str, names: list[str], hashed: bool, tag: str) -> tuple[str, str, str, list[str]]:
    """SQL of ranked joins, anchor after anchor; the names of what is left and of the steps."""
    sql, steps = "", []
    for i, name in enumerate(names):
        key = ["pair_id", "k", *(["text_hash"] if hashed else [])]
        for side, src in (("o", old), ("n", new)):
            sql += f", {tag}{side}k{i} AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY chunk_index, chunk_id) r FROM (SELECT *, {_anchor_sql(name)} k FROM {src}) WHERE k IS NOT NULL)"
        step = f"{tag}m{i}"
        sql += f", {step} AS (SELECT a.pair_id, a.chunk_id old_id, b.chunk_id new_id, '{name}' AS match_reason FROM {tag}ok{i} a JOIN {tag}nk{i} b USING ({', '.join([*key, 'r'])}))"
        sql += f", {tag}o{i} AS (SELECT * FROM {old} WHERE (pair_id, chunk_id) NOT IN (SELECT (pair_id, old_id) FROM {step})), {tag}n{i} AS (SELECT * FROM {new} WHERE (pair_id, chunk_id) NOT IN (SELECT (pair_id, new_id) FROM {step}))"
        old, new = f"{tag}o{i}", f"{tag}n{i}"
        steps.append(step)
    return sql, old, new, steps


_ANCHORED = "(" + " OR ".join(f"{_anchor_sql(a)} IS NOT NULL" for a in matching.ANCHORS) + ")"
_s1, _o1, _n1, _m1 = _passes("o0", "n0", [*matching.ANCHORS, "same_index"], True, "x")
_LEFT = f""", lf AS (SELECT pair_id, text_hash, chunk_id, chunk_index, 0 side, {_ANCHORED} a FROM {_o1} UNION ALL SELECT pair_id, text_hash, chunk_id, chunk_index, 1, {_ANCHORED} FROM {_n1}),
lw AS (SELECT *, bool_or(a) OVER g an, count(*) FILTER (WHERE side = 0) OVER g c0, count(*) FILTER (WHERE side = 1) OVER g c1, row_number() OVER (PARTITION BY pair_id, text_hash, side ORDER BY chunk_index, chunk_id) r FROM lf WINDOW g AS (PARTITION BY pair_id, text_hash)),
lk AS (SELECT * FROM lw WHERE c0 > 0 AND c1 > 0 AND (NOT an OR (c0 = 1 AND c1 = 1))),
same AS ({' UNION ALL '.join(f'SELECT pair_id, old_id, new_id FROM {m}' for m in _m1)} UNION ALL
  SELECT a.pair_id, a.chunk_id, b.chunk_id FROM (SELECT * FROM lk WHERE side = 0) a JOIN (SELECT * FROM lk WHERE side = 1) b USING (pair_id, text_hash, r)),
eo AS (SELECT * FROM o0 WHERE (pair_id, chunk_id) NOT IN (SELECT (pair_id, old_id) FROM same)), en AS (SELECT * FROM n0 WHERE (pair_id, chunk_id) NOT IN (SELECT (pair_id, new_id) FROM same))"""
_s2, _o2, _n2, _m2 = _passes("eo", "en", list(matching.ANCHORS), False, "y")
SAME = V + CH + _s1 + _LEFT
CHANGED = SAME + _s2 + f", changed AS ({' UNION ALL '.join(f'SELECT * FROM {m}' for m in _m2)})"
EDITS = CHANGED + f""", edits AS (SELECT pair_id, 'modified' operation, old_id, new_id FROM changed UNION ALL SELECT pair_id, 'removed', chunk_id, NULL FROM {_o2} UNION ALL SELECT pair_id, 'added', NULL, chunk_id FROM {_n2})"""


def pairs_of(spark, sf_dir):
    """Consecutive versions; the older version's id is the pair's id."""
    p = matching.consecutive(versions(spark, sf_dir, "document_id", "version_number"))
    return p.withColumn("pair_id", F.col("from_id"))


def all_chunks(spark, sf_dir):
    return chunks(spark, sf_dir, "version_id", *[c for c in matching.CHUNK_COLUMNS if c != "chunk_id"])


def edits(spark, sf_dir, scored=False, rated=False):
    return matching.version_diff(pairs_of(spark, sf_dir), all_chunks(spark, sf_dir), scored, rated)


@query("D01_invalid_pairs", """
WITH v AS (SELECT DISTINCT version_id, document_id, version_number FROM document_versions)
SELECT a.version_id AS from_id, a.version_id + 1 AS to_id, CASE WHEN b.version_id IS NULL THEN 'unknown version' WHEN a.document_id <> b.document_id THEN 'other document' ELSE 'not newer' END AS reason
FROM v a LEFT JOIN v b ON b.version_id = a.version_id + 1 WHERE b.version_id IS NULL OR a.document_id <> b.document_id OR a.version_number >= b.version_number""")
def d01(spark, sf_dir):
    v = versions(spark, sf_dir, "document_id", "version_number")
    return matching.invalid_pairs(v.select(F.col("version_id").alias("from_id"), (F.col("version_id") + 1).alias("to_id")), v)


@query("D02_consecutive_pairs", V + "SELECT document_id, from_id, to_id FROM pairs")
def d02(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("document_id", "from_id", "to_id")


@query("D03_grouping_key", "SELECT doc_id, CASE WHEN (SELECT max(n) FROM (SELECT count(*) n FROM documents GROUP BY doc_id)) > 1 THEN doc_id::VARCHAR ELSE coalesce(family_key, doc_id::VARCHAR) END AS grp FROM documents")
def d03(spark, sf_dir):
    """By id if any id repeats, else by family; the flag is one row that is joined."""
    d = load(spark, sf_dir, "documents", "doc_id", "family_key")
    flag = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") > 1).alias("repeats"))
    return d.join(F.broadcast(flag)).select("doc_id", F.when(F.col("repeats"), F.col("doc_id").cast("string")).otherwise(F.coalesce("family_key", F.col("doc_id").cast("string"))).alias("grp"))


@query("D04_D05_exact_matches", SAME + "SELECT pair_id, old_id, new_id FROM same")
def d04(spark, sf_dir):
    return edits(spark, sf_dir).where("stage = 'hash'").select("pair_id", "old_id", "new_id")


@query("D06_anchored_matches", CHANGED + "SELECT pair_id, old_id, new_id, match_reason FROM changed")
def d06(spark, sf_dir):
    return edits(spark, sf_dir).where("stage = 'anchor'").select("pair_id", "old_id", "new_id", "match_reason")


@query("D07_D08_scored_matches")
def d07(spark, sf_dir):
    return edits(spark, sf_dir, scored=True).where("stage = 'scored'").select("pair_id", "old_id", "new_id", "similarity", "match_reason")


@query("D09_similarity")
def d09(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text").distinct()
    return a.select("annotation_id", F.bround(matching.similarity("old_text", "new_text"), 4).alias("similarity"))


@query("D10_unmatched", EDITS + "SELECT pair_id, operation, coalesce(old_id, new_id) AS chunk_id FROM edits WHERE operation <> 'modified'")
def d10(spark, sf_dir):
    return edits(spark, sf_dir).where("operation in ('added', 'removed')").select("pair_id", "operation", F.coalesce("old_id", "new_id").alias("chunk_id"))


@query("D11_document_fallback", V + """,
n AS (SELECT version_id, count(DISTINCT chunk_id) n FROM chunks GROUP BY 1), t AS (SELECT DISTINCT version_id, coalesce(normalized_text, '') t FROM document_versions)
SELECT from_id AS pair_id, CASE WHEN a.t = '' AND b.t = '' THEN 'empty' WHEN a.t = b.t THEN 'unchanged' WHEN a.t = '' THEN 'added' WHEN b.t = '' THEN 'removed' ELSE 'modified' END AS operation
FROM pairs JOIN t a ON a.version_id = from_id JOIN t b ON b.version_id = to_id LEFT JOIN n x ON x.version_id = from_id LEFT JOIN n y ON y.version_id = to_id WHERE x.n IS NULL OR y.n IS NULL""")
def d11(spark, sf_dir):
    return matching.document_fallback(pairs_of(spark, sf_dir), versions(spark, sf_dir, "normalized_text"), chunks(spark, sf_dir, "version_id"))


@query("D12_line_diff")
def d12(spark, sf_dir):
    t = versions(spark, sf_dir, "normalized_text")
    p = pairs_of(spark, sf_dir).join(t.select(F.col("version_id").alias("from_id"), F.col("normalized_text").alias("a")), "from_id").join(t.select(F.col("version_id").alias("to_id"), F.col("normalized_text").alias("b")), "to_id")
    return p.select("pair_id", matching.line_diff("a", "b").alias("diff"))


@query("D13_version_diff", EDITS + """, every AS (SELECT pair_id, operation FROM edits UNION ALL SELECT pair_id, 'unchanged' FROM same)
SELECT pair_id, count(*) FILTER (WHERE operation = 'added') AS n_added, count(*) FILTER (WHERE operation = 'removed') AS n_removed, count(*) FILTER (WHERE operation = 'modified') AS n_modified,
  count(*) FILTER (WHERE operation = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE operation <> 'unchanged') = 0 AS identical FROM every GROUP BY 1""")
def d13(spark, sf_dir):
    return matching.diff_counts(edits(spark, sf_dir))


@query("D13_version_diff_scored")
def d13s(spark, sf_dir):
    return edits(spark, sf_dir, scored=True, rated=True)


@query("D14_change_order", EDITS + """
SELECT e.pair_id, operation, old_id, new_id, row_number() OVER (PARTITION BY e.pair_id ORDER BY chunk_index,
  coalesce(CASE WHEN length(path_key) > 0 THEN path_key END, CASE WHEN length(section_path) > 0 THEN section_path END, CASE WHEN length(heading) > 0 THEN heading END, ''),
  CASE operation WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, coalesce(old_id, 0), coalesce(new_id, 0)) AS sort_order
FROM edits e JOIN ch ON ch.chunk_id = coalesce(new_id, old_id)""")
def d14(spark, sf_dir):
    return matching.ordered_changes(edits(spark, sf_dir), all_chunks(spark, sf_dir)).select("pair_id", "operation", "old_id", "new_id", F.col("sort_order").cast("bigint").alias("sort_order"))


@query("D15_line_block_diff")
def d15(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text").distinct()
    return matching.block_diff(a, ["annotation_id"], "old_text", "new_text")


@query("D16_paragraph_block_diff")
def d16(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text").distinct()
    return matching.block_diff(a, ["annotation_id"], "old_text", "new_text", "paragraph")


@query("D17_changed_pairs", EDITS + "SELECT document_id, count(DISTINCT edits.pair_id) AS n_changed FROM edits JOIN pairs ON pairs.from_id = edits.pair_id GROUP BY 1")
def d17(spark, sf_dir):
    changed = edits(spark, sf_dir).where("operation <> 'unchanged'").select("pair_id").distinct()
    return pairs_of(spark, sf_dir).join(changed, "pair_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_changed"))


@query("D19_label_overlay", """
WITH b AS (SELECT DISTINCT annotation_id, change_id, importance FROM annotation), p AS (SELECT change_id, min(predicted_label) l FROM predictions WHERE change_id IS NOT NULL GROUP BY 1)
SELECT annotation_id, coalesce(p.l, importance) AS importance, p.l IS NOT NULL AS corrected FROM b LEFT JOIN p USING (change_id)""")
def d19(spark, sf_dir):
    base = load(spark, sf_dir, "annotation", "annotation_id", "change_id", "importance").distinct()
    fix = load(spark, sf_dir, "predictions", "change_id", "predicted_label").where("change_id is not null").groupBy("change_id").agg(F.min("predicted_label").alias("importance"))
    return overlay(base, fix, ["change_id"], "importance").select("annotation_id", "importance", "corrected")


@query("D22_D23_semi_and_anti", """
SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS has_returns FROM supplier
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 0)""")
def d22(spark, sf_dir):
    s = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    kept = s.join(load(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_anti")
    back = load(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return kept.join(back.withColumn("_r", F.lit(True)), "s_suppkey", "left").select("s_suppkey", F.coalesce("_r", F.lit(False)).alias("has_returns"))


_scores, _label = rules.TOPICS.sql("old_text", "new_text")
A = "a AS (SELECT DISTINCT annotation_id, pair_id, change_type, importance, old_text, new_text, requires_manual_review FROM annotation)"


def annotations(spark, sf_dir, *columns):
    return load(spark, sf_dir, "annotation", "annotation_id", *columns).distinct()


@query("E02_E03_topic_scores", f"WITH {A} SELECT annotation_id, {', '.join(f'({s})::INT AS s_{k}' for k, s in _scores.items())}, {_label} AS topic FROM a")
def e02(spark, sf_dir):
    texts = [F.col("old_text"), F.col("new_text")]
    scores = rules.TOPICS.scores(*texts)
    return annotations(spark, sf_dir, "old_text", "new_text").select("annotation_id", *[s.alias(f"s_{k}") for k, s in scores.items()], rules.TOPICS.label(*texts).alias("topic"))


@query("E07_E15_histograms", f"WITH {A} SELECT pair_id, " + ", ".join(f"count(*) FILTER (WHERE {_label} = '{k}') AS n_{k}" for k in [*rules.TOPICS.priority, "other"]) + ", count(*) FILTER (WHERE requires_manual_review) AS n_review FROM a GROUP BY 1")
def e07(spark, sf_dir):
    a = annotations(spark, sf_dir, "pair_id", "old_text", "new_text", "requires_manual_review").withColumn("topic", rules.TOPICS.label(F.col("old_text"), F.col("new_text")))
    return a.groupBy("pair_id").agg(*rules.zero_filled(F.col("topic"), [*rules.TOPICS.priority, "other"]), F.count_if("requires_manual_review").alias("n_review"))


_low = "lower(coalesce(old_text, '') || ' ' || coalesce(new_text, ''))"
_hits = [f"CASE WHEN regexp_matches({_low}, '{p}') THEN {s} ELSE 0 END" for _, p, s in rules.SIGNIFICANCE.rungs]
_best = f"greatest({', '.join(_hits)})"
_SIG = f"CASE WHEN {_best} = 0 THEN 'not_evaluated' " + " ".join(f"WHEN {h} = {_best} THEN '{label}'" for h, (label, _, _) in zip(_hits, rules.SIGNIFICANCE.rungs)) + " END"


def significant(spark, sf_dir):
    a = annotations(spark, sf_dir, "pair_id", "change_type", "old_text", "new_text", "requires_manual_review", "description")
    both = F.concat(F.coalesce("old_text", F.lit("")), F.lit(" "), F.coalesce("new_text", F.lit("")))
    return a.withColumn("s", rules.SIGNIFICANCE.best(both)).withColumns({"label": F.col("s.label"), "confidence": F.col("s.confidence"), "n_reasons": F.size("s.reasons").cast("bigint")})


@query("E08_E10_significance", f"WITH {A} SELECT annotation_id, {_SIG} AS label, round_even({_best} / 100.0, 2)::DOUBLE AS confidence, ({' + '.join(f'({h} > 0)::INT' for h in _hits)})::BIGINT AS n_reasons FROM a")
def e08(spark, sf_dir):
    return significant(spark, sf_dir).select("annotation_id", "label", "confidence", "n_reasons")


PRIORITY = {"critical": 4, "important": 3, "informational": 2, "editorial": 1, "not_evaluated": 0}
_PRIO = f"CASE {_SIG} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END"


def prio(c):
    return F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), c)


@query("E16_E17_prioritised", f"""
WITH {A}, r AS (SELECT pair_id, annotation_id, row_number() OVER (PARTITION BY pair_id ORDER BY {_PRIO} DESC, coalesce(requires_manual_review, false) DESC, {_best} DESC, annotation_id) rank FROM a)
SELECT * FROM r WHERE rank <= 5""")
def e16(spark, sf_dir):
    order = [F.desc("_p"), F.desc("_m"), F.desc("confidence"), "annotation_id"]
    s = significant(spark, sf_dir).withColumns({"_p": prio(F.col("label")), "_m": F.coalesce("requires_manual_review", F.lit(False))})
    return topk.top(s, ["pair_id"], order, 5).select("pair_id", "annotation_id", F.col("rank").cast("bigint").alias("rank"))


@query("E19_change_identity", f"WITH {A} SELECT annotation_id, sha256(concat_ws('||', pair_id, lower(change_type), coalesce(old_text, ''), coalesce(new_text, ''))) AS change_key FROM a")
def e19(spark, sf_dir):
    key = F.sha2(F.concat_ws("||", "pair_id", F.lower("change_type"), F.coalesce("old_text", F.lit("")), F.coalesce("new_text", F.lit(""))), 256)
    return annotations(spark, sf_dir, "pair_id", "change_type", "old_text", "new_text").select("annotation_id", key.alias("change_key"))


@query("E21_timeline", f"""
WITH {A} SELECT annotation_id, row_number() OVER (PARTITION BY pair_id ORDER BY CASE lower(change_type) WHEN 'modified' THEN 0 WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, annotation_id) AS place,
  count(*) FILTER (WHERE importance = 'critical') OVER (PARTITION BY pair_id) AS n_critical FROM a""")
def e21(spark, sf_dir):
    kind = F.lower("change_type")
    w = Window.partitionBy("pair_id")
    order = F.when(kind == "modified", 0).when(kind == "added", 1).when(kind == "removed", 2).otherwise(3)
    a = annotations(spark, sf_dir, "pair_id", "change_type", "importance")
    return a.select("annotation_id", F.row_number().over(w.orderBy(order, "annotation_id")).cast("bigint").alias("place"), F.count_if(F.col("importance") == "critical").over(w).alias("n_critical"))


@query("F01_F09_entities")
def f01(spark, sf_dir):
    return entities.extract(chunks(spark, sf_dir, "text"), ["chunk_id"], "text")


@query("F06_references_counted", "SELECT DISTINCT chunk_id, len(regexp_extract_all(lower(text), '(ст|п|ч|гл|art|sec|para|abs|nr|kap|chap)\\.\\s*[0-9]+(\\.[0-9]+)*')) AS n FROM chunks WHERE length(text) > 0")
def f06(spark, sf_dir):
    c = load(spark, sf_dir, "chunks", "chunk_id", "text").where("length(text) > 0")
    return c.select("chunk_id", F.regexp_count(F.lower("text"), F.lit(r"(ст|п|ч|гл|art|sec|para|abs|nr|kap|chap)\.\s*[0-9]+(\.[0-9]+)*")).cast("bigint").alias("n")).distinct()


@query("F11_F15_merged_entities")
def f11(spark, sf_dir):
    """Rules over chunks merged with a second method: a narrower pack that is surer of deadlines."""
    from dataclasses import replace

    sure = tuple(replace(r, confidence=0.99) for r in entities.RULES if r.entity_type == "deadline")
    c = chunks(spark, sf_dir, "text")
    return entities.merge(entities.extract(c, ["chunk_id"], "text"), entities.extract(c, ["chunk_id"], "text", sure).withColumn("extraction_method", F.lit("sure")), ["chunk_id"])


@query("F16_F17_entity_counts")
def f17(spark, sf_dir):
    return entities.compare_methods(f11(spark, sf_dir))


@query("G01_summary_selection", f"""
WITH {A}, s AS (SELECT pair_id, annotation_id, {_SIG} <> 'not_evaluated' p, {_PRIO} pr FROM a),
m AS (SELECT *, bool_or(p) OVER (PARTITION BY pair_id) an FROM s), k AS (SELECT * FROM m WHERE p OR NOT an),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pr DESC, annotation_id) rank, count(*) OVER (PARTITION BY pair_id) n FROM k)
SELECT pair_id, annotation_id, rank, CASE WHEN an THEN 'primary' ELSE 'fallback' END AS scope, greatest(n - CASE WHEN an THEN 5 ELSE 3 END, 0) AS n_truncated FROM r WHERE rank <= CASE WHEN an THEN 5 ELSE 3 END""")
def g01(spark, sf_dir):
    s = significant(spark, sf_dir).withColumn("_p", prio(F.col("label")))
    out = topk.pooled(s.withColumnRenamed("_p", "prio"), ["pair_id"], F.col("label") != "not_evaluated", [F.desc("prio"), "annotation_id"], 5, 3)
    return out.select("pair_id", "annotation_id", F.col("rank").cast("bigint").alias("rank"), "scope", F.col("n_truncated").cast("bigint").alias("n_truncated"))


@query("G02_G06_brief", f"""
WITH {A}, g AS (SELECT pair_id, count(*) FILTER (WHERE lower(change_type) = 'added') x, count(*) FILTER (WHERE lower(change_type) = 'modified') y, count(*) FILTER (WHERE lower(change_type) = 'removed') z FROM a GROUP BY 1)
SELECT pair_id, concat_ws(', ', CASE WHEN x > 0 THEN 'added: ' || x END, CASE WHEN y > 0 THEN 'modified: ' || y END, CASE WHEN z > 0 THEN 'removed: ' || z END) AS brief FROM g""")
def g02(spark, sf_dir):
    kinds = ("added", "modified", "removed")
    g = annotations(spark, sf_dir, "pair_id", "change_type").groupBy("pair_id").agg(*rules.zero_filled(F.lower("change_type"), kinds))
    return g.select("pair_id", F.concat_ws(", ", *[F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{k}: "), F.col(f"n_{k}").cast("string"))) for k in kinds]).alias("brief"))


@query("G03_first_numbers", f"WITH {A} SELECT annotation_id, CASE WHEN o = '' OR n = '' THEN 'clarified' WHEN o::BIGINT > n::BIGINT THEN 'shortened' WHEN o::BIGINT < n::BIGINT THEN 'extended' ELSE 'clarified' END AS change FROM (SELECT annotation_id, regexp_extract(old_text, '([0-9]{{1,9}})', 1) o, regexp_extract(new_text, '([0-9]{{1,9}})', 1) n FROM a WHERE old_text IS NOT NULL AND new_text IS NOT NULL)")
def g03(spark, sf_dir):
    a = annotations(spark, sf_dir, "old_text", "new_text").where("old_text is not null and new_text is not null")
    first = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9]{{1,9}})', 1) as bigint)")
    return a.select("annotation_id", F.when(first("old_text") > first("new_text"), "shortened").when(first("old_text") < first("new_text"), "extended").otherwise("clarified").alias("change"))


@query("H03_first_per_signature", f"WITH {A} SELECT pair_id, min(annotation_id) AS annotation_id FROM a WHERE length(coalesce(new_text, old_text)) >= 20 GROUP BY pair_id, lower(change_type), importance")
def h03(spark, sf_dir):
    a = annotations(spark, sf_dir, "pair_id", "change_type", "importance", "old_text", "new_text").where(F.length(F.coalesce("new_text", "old_text")) >= 20).withColumn("kind", F.lower("change_type"))
    return topk.first_of(a, ["pair_id", "kind", "importance"], ["annotation_id"]).select("pair_id", "annotation_id")


@query("H04_diversified_pick", f"""
WITH {A}, k AS (SELECT pair_id, annotation_id, {_label} topic FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, topic ORDER BY annotation_id) k FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k, annotation_id) pick FROM r WHERE k <= 2)
SELECT pair_id, annotation_id, pick FROM p WHERE pick <= 10""")
def h04(spark, sf_dir):
    a = annotations(spark, sf_dir, "pair_id", "old_text", "new_text").withColumn("topic", rules.TOPICS.label(F.col("old_text"), F.col("new_text")))
    return topk.diversified(a, ["pair_id"], "topic", ["annotation_id"], 10).select("pair_id", "annotation_id", F.col("pick").cast("bigint").alias("pick"))


@query("H06_choices")
def h06(spark, sf_dir):
    a = annotations(spark, sf_dir, "pair_id", "old_text", "new_text").withColumns({"topic": rules.TOPICS.label(F.col("old_text"), F.col("new_text")), "answer": text.truncate(F.coalesce("new_text", "old_text", F.lit("")), 60)})
    picked = topk.diversified(a, ["pair_id"], "topic", ["annotation_id"], 10)
    return topk.with_choices(picked, ["pair_id"], "answer", "pick", ("no change", "see the text", "not stated")).select("pair_id", "annotation_id", "pick", "answer", "choices", "correct_index")
