import unicodedata

import pytest
from pyspark.sql import functions as F

from actloom.functions import text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a b—c", "a b-c"),
        ("x​­﻿y", "xy"),
        ("a \r\n  b\rc", "a\nb\nc"),
        ("p1\fp2", "p1\n\np2"),
        ("a\n\n\n\nb   c\t\td", "a\n\nb c d"),
        (" \n é ", unicodedata.normalize("NFC", "é")),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_text, raw) == want


def test_normalize_changes_nothing_twice(spark):
    once = one(spark, text.normalize_text, " a – b \n\n\n c ")
    assert one(spark, text.normalize_text, once) == once


@pytest.mark.parametrize(("items", "want"), [([], ""), (["a"], "a"), (["a", "b", "a"], "a и b"), (["a", "b", "c"], "a, b и c"), ([None, "", "z"], "z")])
def test_human_join(spark, items, want):
    assert spark.createDataFrame([(items,)], "t array<string>").select(text.human_join(F.col("t")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(("raw", "want"), [("2024-03-01", "2024-03-01"), ("2024.03.01", "2024-03-01"), ("1.3.2024", "2024-03-01"), ("soon", "None"), (None, "None")])
def test_dates(spark, raw, want):
    assert str(one(spark, text.parse_date, raw)) == want


def test_truncate_and_snippet(spark):
    assert one(spark, lambda c: text.truncate(c, 5), "abcdefg") == "abcd…"
    assert one(spark, lambda c: text.snippet(c, 9), "ab.") == "ab"
    assert one(spark, lambda c: text.truncate(c, 5), None) is None


def test_bool_and_rounding(spark):
    assert one(spark, text.parse_bool, " YES ") is True
    assert one(spark, lambda c: text.parse_bool(c, strict=True), "maybe") is None
    assert one(spark, lambda c: text.safe_divide(F.lit(9), F.lit(32), 4), "x") == 0.2812
    assert one(spark, lambda c: text.safe_divide(F.lit(9), F.lit(0)), "x") == 0.0


def test_title_like(spark):
    assert one(spark, text.looks_like_title, "Положение о чём-то") is True
    assert one(spark, text.looks_like_title, "a\nb\nc\nd") is False
    assert one(spark, text.looks_like_title, "x" * 130 + ".") is False
