import random
from difflib import SequenceMatcher

import pytest

from actloom.operators import matching

COLS = "version_id bigint, chunk_id bigint, chunk_index int, fragment_type string, raw_label string, canonical_label string, path_key string, heading string, section_path string, text string, text_hash string"


def chunk(version, i, text, path=None, kind="point", heading=None, section=None, label=None):
    return (version, version * 1000 + i, i, kind, None, label, path, heading, section, text, str(hash(text)))


def diff(spark, rows, scored=True):
    chunks = spark.createDataFrame(rows, COLS)
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id bigint, from_id bigint, to_id bigint")
    return matching.version_diff(pairs, chunks, scored)


def ops(df):
    return sorted((r.operation, r.old_id, r.new_id) for r in df.collect())


def test_versions_that_are_equal(spark):
    texts = ["a", "b", "b", "c"]
    out = diff(spark, [chunk(v, i, t, f"p:{i}") for v in (1, 2) for i, t in enumerate(texts)])
    assert [r.operation for r in out.collect()] == ["unchanged"] * 4
    assert matching.diff_counts(out).first().identical is True


def test_added_removed_modified(spark):
    rows = [chunk(1, 1, "one", "p:1"), chunk(1, 2, "two words here", "p:2"), chunk(1, 3, "gone", "p:9")]
    rows += [chunk(2, 1, "one", "p:1"), chunk(2, 2, "two words there", "p:2"), chunk(2, 3, "quite new text", "p:5")]
    got = ops(diff(spark, rows))
    assert got == [("added", None, 2003), ("modified", 1002, 2002), ("removed", 1003, None), ("unchanged", 1001, 2001)]


def test_renumbered_text_is_unchanged(spark):
    rows = [chunk(1, 1, "same text", "p:1"), chunk(2, 2, "same text", "p:2"), chunk(2, 1, "new one", "p:7")]
    assert ("unchanged", 1001, 2002) in ops(diff(spark, rows))


def test_leftovers_by_section_path(spark):
    a, b = "the same long sentence about terms", "the same long sentence about a term"
    rows = [chunk(1, 1, a, "p:1", section="s > x"), chunk(2, 9, b, "p:2", section="s > x")]
    row = diff(spark, rows).where("operation = 'modified'").first()
    assert (row.match_reason, row.similarity) == ("section_path", round(SequenceMatcher(None, a, b).ratio(), 4))
    assert ops(diff(spark, rows, scored=False)) == [("added", None, 2009), ("removed", 1001, None)]


def test_equal_texts_at_one_place_under_another_type(spark):
    rows = [chunk(1, 1, "same text", "p:1", kind="point"), chunk(1, 2, "same text", "p:2"), chunk(2, 1, "same text", "q:1", kind="article"), chunk(2, 2, "same text", "q:2")]
    assert ops(diff(spark, rows)) == [("unchanged", 1001, 2001), ("unchanged", 1002, 2002)]


def test_one_path_or_label_is_enough(spark):
    rows = [chunk(1, 1, "abcdefgh", "p:1", kind="point"), chunk(2, 8, "12345678", "p:1", kind="article")]
    assert [(r.operation, r.match_reason) for r in diff(spark, rows).collect()] == [("modified", "path_key")]


def test_every_chunk_is_used_once(spark):
    rnd = random.Random(3)
    rows = [chunk(v, i, rnd.choice("abcdef") * 30, rnd.choice([None, "", "p:1", "p:2"]), heading=rnd.choice([None, "h"]), section=rnd.choice([None, "s"])) for v in (1, 2) for i in range(40)]
    got = diff(spark, rows).collect()
    old = [r.old_id for r in got if r.old_id]
    new = [r.new_id for r in got if r.new_id]
    assert sorted(old) == [1000 + i for i in range(40)] and sorted(new) == [2000 + i for i in range(40)]


def test_nulls_and_empty_tables(spark):
    rows = [(1, 1, None, None, None, None, None, None, None, None, None), (2, 2, None, None, None, None, None, None, None, None, None)]
    assert ops(diff(spark, rows)) == [("added", None, 2), ("removed", 1, None)]
    assert diff(spark, []).count() == 0


def test_invalid_pairs(spark):
    v = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 11, 1)], "version_id bigint, document_id bigint, version_number int")
    p = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 1), (1, 9)], "from_id bigint, to_id bigint")
    got = {(r.from_id, r.to_id): r.reason for r in matching.invalid_pairs(p, v).collect()}
    assert got == {(2, 1): "not newer", (1, 3): "other document", (1, 1): "same version", (1, 9): "unknown version"}


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("x", "", 0.0), ("tide", "diet", 0.25), ("diet", "tide", 0.5)])
def test_ratio(a, b, want):
    assert matching.ratio(a, b) == want


def test_block_diff(spark):
    df = spark.createDataFrame([(1, "same\nold line here\ngone", "same\nold line there"), (2, None, "x")], "id bigint, a string, b string")
    got = sorted((r.id, r.operation, r.old_text, r.new_text) for r in matching.block_diff(df, ["id"], "a", "b").collect())
    assert got == [(1, "modified", "old line here", "old line there"), (1, "removed", "gone", None), (2, "added", None, "x")]
