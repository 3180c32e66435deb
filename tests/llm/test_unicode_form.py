import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actloom.llm import unicode_form as uf


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ａ１２", "A12"), ("é", "é"), ("ёж", "ёж"), ("a​b͏c᠎", "abc"), ("10 kg", "10 kg"), ("a‑b", "a-b"), ("рост", "poст"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("K", "K"), ("⼈日", "人日"), ("ﻻ", "لا"), ("ﻻٔ", "لأ"), ("が", "が"), ("Οмега", "Омега"), ("а́", "á")],
)
def test_same_look(a, b):
    assert uf._form(a, False, True) == uf._form(b, False, True)
    assert uf.one_form(a, False) == uf.one_form(b, False)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("à", "á"), ("Й", "И"), ("A", "a"), ("2", "3"), ("l", "1"), ("①", "1"), ("x  y", "x y"), ("a—b", "a-b"), ("が", "か")])
def test_visible_changes(a, b):
    assert uf.one_form(a, False) != uf.one_form(b, False)


def test_case_folds_in_the_general_form():
    assert uf.one_form("STRASSE") == uf.one_form("straße") and uf.one_form("ПРАВО") == uf.one_form("право")


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.booleans())
def test_table_gives_the_same_form_and_once_is_enough(text, fold):
    form = uf.one_form(text, fold)
    assert uf._form(text, fold, True) == form
    assert uf.one_form(form, fold) == form


def test_columns(spark):
    rows = [(1, "рот", "pот", "k"), (1, "рот", "pот", "k"), (2, "a", "a", "k"), (3, None, "a", "k"), (4, "a", None, "k"), (5, "", "​", "k"), (6, "a", "A", "k")]
    df = spark.createDataFrame(rows, "id int, a string, b string, _form string")
    assert sorted(r.id for r in uf.same_look(df, "a", "b").collect()) == [1, 1, 5]
    assert [r.f for r in df.where("id = 3").select(uf.form(F.col("a")).alias("f")).collect()] == [None]
    assert uf.same_look(df.limit(0), "a", "b").count() == 0


def test_against_the_version_before(spark):
    rows = [(1, 10, 1, "акт"), (2, 10, 2, "aкт"), (2, 10, 2, "aкт"), (3, 10, 4, "акт"), (4, 10, 5, "акт"), (5, 11, 2, "акт"), (6, 11, 3, None), (7, None, 1, "x"), (8, 12, 1, "x"), (9, 12, 2, "y")]
    df = spark.createDataFrame(rows, "id int, d int, n int, t string")
    assert [r.id for r in uf.same_look_as_previous(df, "d", "n", "t", "id").collect()] == [2]
