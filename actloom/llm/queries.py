"""The pN_ queries over the tables of TESTDATA.md, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actloom.core.session import cut_lineage
from actloom.core.tables import load
from actloom.llm import bpe, grouped_split, overlap, packing, quality, segment, sentences, unicode_form


STAND_INS = {"document_id": "pair_id"}


def strategies(spark: SparkSession, sf_dir: str) -> list[grouped_split.Strategy]:
    """The rows of split_info; one a strategy, so they may come to the driver."""
    rows = load(spark, sf_dir, "split_info").select("split_strategy", "metadata.*").collect()
    return [
        grouped_split.Strategy(
            r["split_strategy"],
            tuple(x.strip() for x in (r["group_attr"] or "").split("+") if x.strip()),
            (r["train_share"], r["validation_share"], r["test_share"]),
            r["seed"] or 0,
            STAND_INS,
        )
        for r in rows
    ]


def examples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per strategy and example, however many models and deliveries there are."""
    df = load(spark, sf_dir, "predictions", "split_strategy", "example_id", *columns)
    return df.groupBy("split_strategy", "example_id").agg(*[F.min(c).alias(c) for c in columns])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = [s for s in strategies(spark, sf_dir) if s.fields]
    # both are read more than once: written, the large table is scanned and aggregated once only
    rows = cut_lineage(examples(spark, sf_dir, "split", "document_id", "pair_id"))
    grouped = cut_lineage(grouped_split.with_groups(rows, tied))
    return grouped_split.parted_groups(grouped).select("split_strategy", "example_id")


def p1_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example with the split it is given to under each strategy."""
    plans = strategies(spark, sf_dir)
    grouped = cut_lineage(grouped_split.with_groups(cut_lineage(examples(spark, sf_dir, "document_id", "pair_id")), plans))
    given = grouped_split.assign(grouped, plans)
    return grouped.join(given, ["split_strategy", "group_key"]).select("split_strategy", "example_id", "group_key", F.col("assigned").alias("split"))


def sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normalized_text and chunk text with its row of size_limits (a fixed table of 11 rows)."""
    limits = {r["item_kind"]: (r["max_size"], r["overlap_size"]) for r in load(spark, sf_dir, "size_limits").where("unit = 'chars'").collect()}
    kind = F.lower(F.regexp_replace("fragment_type", r"(?U)^\s+|\s+$", ""))
    kind = F.when(kind.isin([*limits]), kind).otherwise("fallback_block")  # null, blank or unknown

    def of(item: F.Column, which: int) -> F.Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[which])]), item)

    versions = load(spark, sf_dir, "document_versions", "version_id", "normalized_text").select(
        F.lit("version").alias("record_kind"), F.col("version_id").alias("record_id"), F.lit("version_text").alias("item_kind"), F.lit(None).cast("int").alias("chunk_index"), F.col("normalized_text").alias("text")
    )
    chunks = load(spark, sf_dir, "chunks", "chunk_id", "chunk_index", "fragment_type", "text").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), kind.alias("item_kind"), "chunk_index", "text")
    return versions.unionByName(chunks).withColumns({"max_size": of(F.col("item_kind"), 0), "overlap_size": of(F.col("item_kind"), 1)})


ITEM_KEYS = ["record_kind", "record_id", "item_kind", "chunk_index"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = segment.split_oversized(sized_items(spark, sf_dir), ITEM_KEYS, "text", "max_size", "overlap_size", with_text=False)
    return pieces.groupBy("record_kind", "record_id").agg(F.max("hard_cut").alias("hard_cut"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all items that are too long, each item once."""
    pieces = segment.split_oversized(sized_items(spark, sf_dir), ITEM_KEYS, "text", "max_size", "overlap_size")
    return pieces.dropDuplicates(["record_kind", "record_id", "piece_index"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = load(spark, sf_dir, "document_versions", "version_id", "normalized_text")
    chunks = load(spark, sf_dir, "chunks", "chunk_id", "text")
    model = sentences.train(versions.select(F.col("normalized_text").alias("text")).unionByName(chunks.select("text")), "text")
    rows = versions.select(F.struct(F.lit("version").alias("kind"), F.col("version_id").alias("id")).alias("record"), F.col("normalized_text").alias("text"))
    rows = rows.unionByName(chunks.select(F.struct(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")).alias("record"), "text"))
    units = sentences.split_sentences(rows, "record", "text", model)
    return units.select(F.col("record.kind").alias("record_kind"), F.col("record.id").alias("record_id"), "char_start", "char_end")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text")
    changes = unicode_form.same_look(pairs, "old_text", "new_text").select(F.lit("annotation").alias("record_kind"), F.col("annotation_id").alias("record_id")).distinct()
    texts = load(spark, sf_dir, "document_versions", "version_id", "document_id", "version_number", "extracted_text")
    versions = unicode_form.same_look_as_previous(texts, "document_id", "version_number", "extracted_text", "version_id")
    return changes.unionByName(versions.select(F.lit("version").alias("record_kind"), F.col("version_id").alias("record_id")))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of document_versions and annotation in its one form."""
    pairs = load(spark, sf_dir, "annotation", "annotation_id", "old_text", "new_text")
    texts = load(spark, sf_dir, "document_versions", "version_id", "extracted_text")
    fields = F.explode(F.array(F.struct(F.lit("old_text").alias("field"), F.col("old_text").alias("text")), F.struct(F.lit("new_text").alias("field"), F.col("new_text").alias("text"))))
    rows = pairs.select(F.lit("annotation").alias("record_kind"), F.col("annotation_id").alias("record_id"), fields.alias("x")).select("record_kind", "record_id", "x.*")
    rows = rows.unionByName(texts.select(F.lit("version").alias("record_kind"), F.col("version_id").alias("record_id"), F.lit("extracted_text").alias("field"), F.col("extracted_text").alias("text")))
    return rows.select("record_kind", "record_id", "field", unicode_form.form(F.col("text")).alias("form"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "predictions", "split_strategy", "example_id", "text", "split")
    pairs = overlap.cross_split_overlaps(rows, "split_strategy", "example_id", "text", "split")
    return pairs.select("split_strategy", F.col("id_a").alias("example_id_a"), F.col("id_b").alias("example_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples of validation and test overlap with train, per strategy, split and source."""
    rows = load(spark, sf_dir, "predictions", "split_strategy", "example_id", "text", "split", "source")
    pairs = overlap.cross_split_overlaps(rows, "split_strategy", "example_id", "text", "split")
    return overlap.overlap_report(pairs, rows, "split_strategy", "example_id", "split", "source")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(load(spark, sf_dir, "documents"))


def container_size(spark: SparkSession, sf_dir: str) -> int:
    return load(spark, sf_dir, "size_limits").where("item_kind = 'container'").first()["max_size"]


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, container_size(spark, sf_dir), bpe.token_count)


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "common_words", "lang", "word").collect()  # a fixed table of about 165 rows
    common = quality.CommonWords.of([(r["lang"], r["word"]) for r in rows])
    return quality.document_stats(load(spark, sf_dir, "documents", "doc_id", "text"), common)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_stats(spark, sf_dir).where("text_kind <> 'prose'").select("doc_id", "text_kind")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_stats(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_assigned": p1_assigned,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}

SQL: dict[str, str] = {
    "p2_found": """
WITH items AS (
  SELECT 'version' AS record_kind, version_id AS record_id, normalized_text AS text, 'version_text' AS kind FROM document_versions
  UNION ALL
  SELECT 'chunk', chunk_id, text, coalesce(nullif(lower(regexp_replace(fragment_type, '^\\s+|\\s+$', '', 'g')), ''), 'fallback_block') FROM chunks),
long AS (SELECT DISTINCT record_kind, record_id, text, max_size FROM items JOIN size_limits ON item_kind = kind WHERE length(text) > max_size)
SELECT record_kind, record_id,
       max(CAST(list_max(list_transform(string_split_regex(text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}.!?…。！？।۔؟]'), lambda x: length(x))) > max_size AS INT)) AS hard_cut
FROM long GROUP BY 1, 2
""",
    "p1_found": """
WITH RECURSIVE e AS (
  SELECT split_strategy s, example_id x, min(split) split,
         nullif(min(lower(regexp_replace(document_id, '^[\\s]+|[\\s]+$', '', 'g'))), '') d,
         nullif(min(lower(regexp_replace(pair_id, '^[\\s]+|[\\s]+$', '', 'g'))), '') p
  FROM predictions GROUP BY 1, 2),
a AS (SELECT e.*, metadata.group_attr g FROM e JOIN split_info i ON i.split_strategy = e.s WHERE metadata.group_attr IS NOT NULL),
n AS (SELECT s, x, split, g,
        CASE g WHEN 'pair_id' THEN 'p' || p ELSE coalesce('d' || d, 'p' || p) END AS fst,
        CASE WHEN g LIKE '%+%' AND d IS NOT NULL THEN 'p' || p END AS snd FROM a),
l AS (SELECT DISTINCT s, fst u, snd v FROM n WHERE snd IS NOT NULL),
b AS (SELECT s, u, v FROM l UNION SELECT s, v, u FROM l),
r AS (SELECT s, u, u AS v FROM b UNION SELECT r.s, r.u, b.v FROM r JOIN b ON b.s = r.s AND b.u = r.v),
c AS (SELECT s, u, min(v) root FROM r GROUP BY 1, 2),
k AS (SELECT n.s, x, split, coalesce(root, fst, 'x' || x) grp FROM n LEFT JOIN c ON c.s = n.s AND c.u = fst)
SELECT s AS split_strategy, x AS example_id FROM k
WHERE (s, grp) IN (SELECT (s, grp) FROM k GROUP BY s, grp HAVING count(DISTINCT split) > 1)
""",
}
