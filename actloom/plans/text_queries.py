"""Queries of section B and C: scalar text operators, pages, structural chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.core.tables import load
from actloom.functions import markers, text
from actloom.operators import chunking, pages
from actloom.plans.registry import query

STOP = ("the", "and", "для", "или", "при", "der", "die", "und", "les", "des")
FLAGS = {"has_number": "[0-9]", "has_reference": "(ст\\.|п\\.|Art\\.|Sec\\.|Abs\\.)", "has_question": "[?？]", "has_quote": "[«„“「]"}
TRIM = "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]"


def collapsed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{TRIM}+', ' ', 'g'), '^ | $', '', 'g')"


def versions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each version once; repeats are equal in these columns. Queries whose result is small per row
    read the table with repeats instead and make the result distinct, so that texts are not shuffled."""
    return load(spark, sf_dir, "document_versions", "version_id", *columns).dropDuplicates(["version_id"])


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "chunks", "chunk_id", *columns).dropDuplicates(["chunk_id"])


def _normal_sql(c: str) -> str:
    c = f"replace({c}, chr(12), chr(10) || chr(10))"
    c = f"translate(nfc_normalize({c}), '{text.SPACES + text.DASHES}', '{' ' * len(text.SPACES) + '-' * len(text.DASHES)}')"
    c = f"replace(replace(replace(replace({c}, chr(8232), chr(10)), chr(8233), chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    c = f"regexp_replace({c}, '[\\x{{ad}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    c = f"regexp_replace({c}, '[\\x{{0}}-\\x{{8}}\\x{{b}}-\\x{{1f}}\\x{{7f}}]', '', 'g')"
    for pattern, to in (("[ \\t]+\\n", "chr(10)"), ("\\n[ \\t]+", "chr(10)"), ("[ \\t]{2,}", "' '"), ("\\n{3,}", "chr(10) || chr(10)")):
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return f"coalesce(regexp_replace({c}, '^{TRIM}+|{TRIM}+$', '', 'g'), '')"


@query("B01_normalize_text", f"SELECT DISTINCT version_id, sha256({_normal_sql('extracted_text')}) AS content_hash, length({_normal_sql('extracted_text')}) AS n_chars FROM document_versions")
def b01(spark, sf_dir):
    n = text.normalize_text(F.col("extracted_text"))
    return load(spark, sf_dir, "document_versions", "version_id", "extracted_text").select("version_id", n.alias("n")).select("version_id", text.content_hash(F.col("n")).alias("content_hash"), F.length("n").cast("bigint").alias("n_chars")).distinct()


@query("B02_normalize_by_format")
def b02(spark, sf_dir):
    """Paged files by page, others as a whole."""
    v = versions(spark, sf_dir, "source_filename", "extracted_text")
    paged = text.extension(F.col("source_filename")) == ".pdf"
    plain = v.where(~F.coalesce(paged, F.lit(False))).select("version_id", text.normalize_text(F.col("extracted_text")).alias("normalized_text"))
    return plain.unionByName(pages.clean_pages(v.where(paged), "version_id", "extracted_text"))


@query("B03_clean_pages")
def b03(spark, sf_dir):
    return pages.clean_pages(versions(spark, sf_dir, "extracted_text"), "version_id", "extracted_text")


@query("B04_repeated_edges")
def b04(spark, sf_dir):
    return pages.repeated_edges(pages.page_lines(versions(spark, sf_dir, "extracted_text"), "version_id", "extracted_text"), "version_id")


@query("B05_page_noise_dropped")
def b05(spark, sf_dir):
    lines = pages.page_lines(versions(spark, sf_dir, "extracted_text"), "version_id", "extracted_text")
    return pages.without_noise(lines, "version_id").groupBy("version_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("B06_dehyphenated", "SELECT DISTINCT version_id, sha256(regexp_replace(normalized_text, '([\\p{L}\\p{N}])-\\n(\\p{Ll})', '\\1\\2', 'g')) AS h FROM document_versions WHERE normalized_text IS NOT NULL")
def b06(spark, sf_dir):
    v = load(spark, sf_dir, "document_versions", "version_id", "normalized_text").where("normalized_text is not null")
    return v.select("version_id", text.content_hash(pages.dehyphenate(F.col("normalized_text"))).alias("h")).distinct()


@query("B08_content_hash", "SELECT DISTINCT chunk_id, sha256(text) AS h FROM chunks WHERE text IS NOT NULL")
def b08(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", text.content_hash(F.col("text")).alias("h")).distinct()


@query("B10_path_marker", """
SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(canonical_label), '№', 'no'), '[^\\p{L}\\p{N}_.]+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS marker
FROM chunks WHERE canonical_label IS NOT NULL""")
def b10(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "canonical_label").where("canonical_label is not null").select("chunk_id", text.path_marker(F.col("canonical_label")).alias("marker")).distinct()


@query("B11_B12_collapse_and_fold", f"""
SELECT DISTINCT annotation_id, sha256({collapsed('new_text')}) AS collapsed, sha256({collapsed("translate(lower(new_text), 'ё', 'е')")}) AS folded
FROM annotation WHERE new_text IS NOT NULL""")
def b11(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "new_text").where("new_text is not null").distinct()
    return a.select("annotation_id", text.content_hash(text.collapse(F.col("new_text"))).alias("collapsed"), text.content_hash(text.fold(F.col("new_text"))).alias("folded"))


@query("B13_B14_editorial_change", f"""
WITH a AS (SELECT DISTINCT annotation_id, old_text, new_text FROM annotation WHERE old_text IS NOT NULL AND new_text IS NOT NULL),
f AS (SELECT annotation_id, trim(regexp_replace({collapsed("translate(lower(old_text), 'ё', 'е')")}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) o,
             trim(regexp_replace({collapsed("translate(lower(new_text), 'ё', 'е')")}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) n, old_text, new_text FROM a)
SELECT annotation_id FROM f WHERE o = n AND old_text <> new_text""")
def b13(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text").where("old_text is not null and new_text is not null and old_text <> new_text").distinct()
    return a.where(text.editorial_form(F.col("old_text")) == text.editorial_form(F.col("new_text"))).select("annotation_id")


@query("B15_match_form")
def b15(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", text.match_form(F.col("text")).alias("form")).distinct()


@query("B16_topic_form", "SELECT DISTINCT annotation_id, trim(regexp_replace(translate(lower(description), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) AS topic FROM annotation WHERE description IS NOT NULL")
def b16(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "description").where("description is not null").distinct()
    return a.select("annotation_id", text.topic_form(F.col("description")).alias("topic"))


@query("B17_word_sets", "SELECT DISTINCT chunk_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS n_words FROM chunks WHERE text IS NOT NULL")
def b17(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("n_words")).distinct()


@query("B18_content_words", f"""
WITH w AS (SELECT DISTINCT annotation_id, regexp_extract_all(trim(regexp_replace(translate(lower(description), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+') ws FROM annotation WHERE description IS NOT NULL)
SELECT annotation_id, array_to_string(list_filter(ws, lambda x: (length(x) > 2 OR regexp_matches(x, '^[0-9]+$')) AND NOT list_contains({list(STOP)}, x)), ' ') AS words FROM w""")
def b18(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "description").where("description is not null").distinct()
    return a.select("annotation_id", F.array_join(text.content_words(F.col("description"), STOP), " ").alias("words"))


@query("B19_B20_truncate", f"""
WITH c AS (SELECT DISTINCT chunk_id, {collapsed('text')} t FROM chunks WHERE text IS NOT NULL)
SELECT chunk_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substring(t, 1, 79), '\\s+$', '') || '…' END AS short,
       CASE WHEN length(t) <= 60 THEN regexp_replace(t, '[.\\s]+$', '') ELSE regexp_replace(regexp_replace(substring(t, 1, 59), '\\s+$', '') || '…', '[.\\s]+$', '') END AS snippet FROM c""")
def b19(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", text.truncate(F.col("text"), 80).alias("short"), text.snippet(F.col("text"), 60).alias("snippet")).distinct()


@query("B21_human_join", """
WITH l AS (SELECT document_id, coalesce(list_sort(list_distinct(list(language) FILTER (WHERE language IS NOT NULL))), []) ls FROM document_versions GROUP BY 1)
SELECT document_id, CASE WHEN len(ls) = 0 THEN '' WHEN len(ls) = 1 THEN ls[1] ELSE array_to_string(ls[1:len(ls) - 1], ', ') || ' и ' || ls[len(ls)] END AS languages FROM l""")
def b21(spark, sf_dir):
    g = load(spark, sf_dir, "document_versions", "document_id", "language").groupBy("document_id").agg(F.array_sort(F.collect_set("language")).alias("l"))
    return g.select("document_id", text.human_join(F.col("l")).alias("languages"))


@query("B22_family_key", f"""
SELECT doc_id, substring(concat_ws(' | ', nullif(lower({collapsed('source')}), ''), nullif(lower({collapsed('doc_type')}), ''), nullif(lower({collapsed('title')}), ''), nullif(lower({collapsed('family_key')}), '')), 1, 255) AS family
FROM documents""")
def b22(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "source", "doc_type", "title", "family_key")
    return d.select("doc_id", text.family_key(*[F.col(c) for c in ("source", "doc_type", "title", "family_key")]).alias("family"))


@query("B23_parse_dates", """
WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN strftime(document_date, '%Y-%m-%d') WHEN 1 THEN strftime(document_date, '%-d.%-m.%Y') ELSE strftime(document_date, '%Y.%m.%d') END d FROM documents)
SELECT doc_id, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y.%m.%d'), try_strptime(d, '%d.%m.%Y'))::DATE AS parsed FROM s""")
def b23(spark, sf_dir):
    d = F.col("document_date")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("doc_id") % 3 == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    return load(spark, sf_dir, "documents", "doc_id", "document_date").select("doc_id", text.parse_date(spelled).alias("parsed"))


@query("B24_file_names", "SELECT DISTINCT version_id, regexp_extract(source_filename, '([^/\\\\]*)$', 1) AS name, lower(regexp_extract(source_filename, '(\\.[^.]*)$', 1)) AS ext FROM document_versions WHERE source_filename IS NOT NULL")
def b24(spark, sf_dir):
    v = load(spark, sf_dir, "document_versions", "version_id", "source_filename").where("source_filename is not null")
    return v.select("version_id", text.base_name(F.col("source_filename")).alias("name"), text.extension(F.col("source_filename")).alias("ext")).distinct()


@query("B25_B26_rates", "SELECT o_custkey, count(*) AS n, round_even(CASE WHEN count(*) <> 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) ELSE 0 END, 4) AS rate FROM orders GROUP BY 1")
def b25(spark, sf_dir):
    g = load(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.select("o_custkey", "n", text.safe_divide(F.col("f"), F.col("n"), 4).alias("rate"))


@query("B27_first_filled", "SELECT DISTINCT chunk_id, coalesce(CASE WHEN length(trim(heading)) > 0 THEN heading END, CASE WHEN length(trim(section_path)) > 0 THEN section_path END, CASE WHEN length(trim(canonical_label)) > 0 THEN canonical_label END, 'none') AS shown FROM chunks")
def b27(spark, sf_dir):
    c = load(spark, sf_dir, "chunks", "chunk_id", "heading", "section_path", "canonical_label")
    return c.select("chunk_id", F.coalesce(text.first_filled(F.col("heading"), F.col("section_path"), F.col("canonical_label")), F.lit("none")).alias("shown")).distinct()


@query("B29_label_mapping", "SELECT importance, count(*) AS n, CASE importance WHEN 'critical' THEN 'critical' WHEN 'important' THEN 'important' WHEN 'informational' THEN 'minor' WHEN 'editorial' THEN 'minor' ELSE 'unknown' END AS mapped FROM annotation GROUP BY 1, 3")
def b29(spark, sf_dir):
    m = text.mapped(F.col("importance"), {"critical": "critical", "important": "important", "informational": "minor", "editorial": "minor"}, "unknown")
    return load(spark, sf_dir, "annotation", "importance").groupBy("importance", m.alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("B31_stable_hash", "SELECT doc_id, sha256(to_json({'lang': lang, 'source': source, 'title': title})::VARCHAR) AS k FROM documents")
def b31(spark, sf_dir):
    record = F.to_json(F.struct("lang", "source", "title"), {"ignoreNullFields": "false"})  # names in order; null is not ""
    return load(spark, sf_dir, "documents", "doc_id", "lang", "source", "title").select("doc_id", F.sha2(record, 256).alias("k"))


@query("B32_B33_flags", "SELECT DISTINCT chunk_id, " + ", ".join(f"regexp_matches({collapsed('text')}, '{p}')::INT AS {n}" for n, p in FLAGS.items()) + ", CASE WHEN length(text) < 120 THEN 'short' WHEN length(text) < 260 THEN 'medium' ELSE 'long' END AS bucket FROM chunks WHERE text IS NOT NULL")
def b32(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where("text is not null").select("chunk_id", *text.flags(F.col("text"), FLAGS), text.length_bucket(F.col("text")).alias("bucket")).distinct()


@query("B34_title_like", """
SELECT DISTINCT chunk_id FROM chunks
WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) BETWEEN 1 AND 3 AND length(text) <= 220 AND NOT (length(text) > 120 AND regexp_matches(text, '[.;:]$'))""")
def b34(spark, sf_dir):
    return load(spark, sf_dir, "chunks", "chunk_id", "text").where(text.looks_like_title(F.col("text"))).select("chunk_id").distinct()


@query("B36_parse_bool", "SELECT annotation_id, (lower(trim(requires_manual_review::VARCHAR)) IN ('1', 'true', 'yes')) AS review FROM (SELECT DISTINCT annotation_id, coalesce(requires_manual_review, false) requires_manual_review FROM annotation)")
def b36(spark, sf_dir):
    a = load(spark, sf_dir, "annotation", "annotation_id", "requires_manual_review").distinct()
    return a.select("annotation_id", text.parse_bool(F.col("requires_manual_review").cast("string")).alias("review"))


# What passports, addresses and telephone numbers look like.
PERSONAL = {
    "passport_like": r"[0-9]{4} [0-9]{6}",
    "email_like": r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+",
    "phone_like": r"(?:\+7|8)\s?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}",
}


@query("B37_personal_data_flags", "SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {n}" for n, p in PERSONAL.items()) + " FROM documents")
def b37(spark, sf_dir):
    return load(spark, sf_dir, "documents", "text").agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in PERSONAL.items()])


@query("B38_json_flatten", "SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def b38(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "props")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


_LINES = f"""
WITH t AS (SELECT DISTINCT version_id, string_split(normalized_text, chr(10)) ls FROM document_versions WHERE normalized_text IS NOT NULL),
l AS (SELECT version_id, unnest(range(len(ls))) i, ls FROM t),
s AS (SELECT version_id, i AS line_no, regexp_replace(ls[i + 1], '^{TRIM}+|{TRIM}+$', '', 'g') line FROM l),
k AS (SELECT version_id, line_no, line, {markers.line_kind_sql('line')} kind FROM s)
"""


@query("C02_line_kinds", _LINES + "SELECT version_id, kind, count(*) AS n FROM k GROUP BY 1, 2")
def c02(spark, sf_dir):
    v = versions(spark, sf_dir, "normalized_text").where("normalized_text is not null")
    lines = v.select("version_id", F.explode(F.split("normalized_text", "\n")).alias("line"))
    return lines.groupBy("version_id", markers.line_kind(text.strip(F.col("line"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("C03_C04_line_context", _LINES + """,
c AS (SELECT *, max(CASE WHEN kind = 'section' THEN line_no END) OVER w s, max(CASE WHEN kind = 'chapter' THEN line_no END) OVER w c, max(CASE WHEN kind = 'article' THEN line_no END) OVER w a
      FROM k WINDOW w AS (PARTITION BY version_id ORDER BY line_no)),
o AS (SELECT *, CASE WHEN c > coalesce(s, -1) THEN c END chapter_line, CASE WHEN a > greatest(coalesce(s, -1), coalesce(c, -1)) THEN a END article_line, greatest(coalesce(s, -1), coalesce(c, -1), coalesce(a, -1)) r FROM c),
b AS (SELECT *, CASE WHEN kind <> 'bracket' THEN kind WHEN max(CASE WHEN kind IN ('point', 'bracket') THEN 1 END) OVER (PARTITION BY version_id, r ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'subpoint' ELSE 'point' END k2 FROM o)
SELECT version_id, line_no, k2 AS kind, s AS section_line, chapter_line, article_line, max(CASE WHEN k2 = 'point' THEN line_no END) OVER (PARTITION BY version_id, r ORDER BY line_no) AS point_line FROM b""")
def c03(spark, sf_dir):
    return chunking.line_context(versions(spark, sf_dir, "normalized_text"), "version_id", "normalized_text").drop("line")


@query("C01_structural_chunks")
def c01(spark, sf_dir):
    return chunking.chunk_documents(versions(spark, sf_dir, "normalized_text"), ["version_id"], "normalized_text")


@query("C09_greedy_packing")
def c09(spark, sf_dir):
    """Chunks longer than the limit, cut on blank lines and lines; counts of parts."""
    parts = chunking.chunk_documents(chunks(spark, sf_dir, "text"), ["chunk_id"], "text", lambda t: [(i, "fallback_block", 0, "", "", "", "", "", p, "") for i, p in enumerate(chunking.pieces(t), 1)])
    return parts.select("chunk_id", "chunk_index", F.length("text").alias("n_chars"))


@query("C12_chunk_indexing", "WITH c AS (SELECT DISTINCT chunk_id, version_id, chunk_index FROM chunks) SELECT chunk_id, row_number() OVER (PARTITION BY version_id ORDER BY chunk_index, chunk_id) AS dense_index FROM c")
def c12(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("version_id").orderBy("chunk_index", "chunk_id")
    return chunks(spark, sf_dir, "version_id", "chunk_index").select("chunk_id", F.row_number().over(w).cast("bigint").alias("dense_index"))


@query("C14_paragraph_chunks", f"""
WITH t AS (SELECT DISTINCT version_id, normalized_text t FROM document_versions WHERE normalized_text IS NOT NULL),
p AS (SELECT version_id, unnest(list_filter(list_transform(string_split_regex(t, '\\n[\\s\\p{{Z}}]*\\n'), lambda x: regexp_replace(x, '^{TRIM}+|{TRIM}+$', '', 'g')), lambda x: x <> '')) b FROM t)
SELECT version_id, count(*) AS n, sum(length(b))::BIGINT AS n_chars FROM p GROUP BY 1""")
def c14(spark, sf_dir):
    c = chunking.chunk_documents(versions(spark, sf_dir, "normalized_text"), ["version_id"], "normalized_text", chunking.paragraphs)
    return c.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("C15_heading_chunks")
def c15(spark, sf_dir):
    return chunking.chunk_documents(versions(spark, sf_dir, "normalized_text"), ["version_id"], "normalized_text", chunking.headed)
