import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.llm import segment

RUN = re.compile(r"[^\s.!?…。！？।۔؟]+")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abé 。.\n,，!?ก")), max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_pieces_give_back_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = segment.cut(text, limit, overlap)
    assert "".join(text[p.fresh : p.end] for p in pieces) == text
    assert all(0 < p.end - p.start <= limit and p.fresh - overlap <= p.start <= p.fresh for p in pieces)
    if len(text) > limit:
        assert any(p.hard for p in pieces) == any(len(r) > limit for r in RUN.findall(text))


def test_cut_at_the_change_of_topic():
    cats, tax = "The cat saw another cat near the cat house. ", "A tax on every tax return raises the tax due. "
    text = cats * 9 + tax * 9
    first = segment.cut(text, 600, 0)[0]
    assert first.end == len(cats) * 9


def test_boundary_between_vocabularies():
    """Two topics with words of their own and shared function words: the deepest valley of the window is the boundary."""
    hits = 0
    for k in range(100):
        rnd = random.Random(k)
        common = [f"f{i}" for i in range(20)]
        topics = [[f"{side}{rnd.randrange(10**6)}" for _ in range(60)] for side in "ab"]
        sentence = lambda t: " ".join(rnd.choice(common if rnd.random() < 0.5 else topics[t]) for _ in range(rnd.randint(8, 14))).capitalize() + ". "
        sides = ["".join(sentence(t) for _ in range(rnd.randint(12, 18))) for t in (0, 1)]
        limit = int(len(sides[0]) * rnd.uniform(1.1, 1.7))
        hits += segment.cut("".join(sides), limit, 0)[0].end == len(sides[0])
    assert hits >= 80


def test_clause_marks_without_blanks_are_pauses():
    text = ("甲" * 15 + "，") * 40
    pieces = segment.cut(text, 100, 20)
    assert all(text[p.end - 1] == "，" for p in pieces[:-1])
    assert all(p.hard for p in pieces[:-1]) and all(p.fresh - p.start == 16 for p in pieces[1:])
    assert not any(p.hard for p in segment.cut(("甲" * 15 + "，" + "乙" * 15 + "。") * 10, 40, 0))


def test_overlap_of_a_run_without_pauses():
    assert [(p.start, p.end, p.fresh) for p in segment.cut("x" * 25, 10, 4)] == [(0, 10, 0), (6, 16, 10), (15, 25, 16)]


def test_overlap_begins_at_a_pause():
    text = "One two three four. " * 30
    for p in segment.cut(text, 120, 40)[1:]:
        assert text[p.start : p.start + 3] == "One" and 0 < p.fresh - p.start <= 40


def test_very_long_run():
    pieces = segment.cut("x" * 100_000, 1000, 100)
    assert all(p.hard for p in pieces[:-1]) and pieces[-1].end == 100_000


def test_bad_parameters():
    with pytest.raises(ValueError):
        segment.cut("abc", 2, 2)


def test_table(spark):
    rows = [(1, "a b c d e f", 4, 0, "x"), (2, "short", 100, 0, "x"), (3, None, 4, 0, "x"), (4, "long text", None, 0, "x"), (5, "abcdefgh", 4, None, "x"), (1, "a b c d e f", 4, 0, "x")]
    df = spark.createDataFrame(rows, "id int, t string, m int, o int, piece string")
    got = sorted((r.id, r.piece_index, r.piece, r.hard_cut) for r in segment.split_oversized(df, ["id"], "t", "m", "o").collect())
    assert got == sorted([(1, 1, "a b ", 0), (1, 2, "c d ", 0), (1, 3, "e f", 0)] * 2 + [(5, 1, "abcd", 1), (5, 2, "efgh", 0)])
    assert segment.split_oversized(df.limit(0), ["id"], "t", "m", "o").count() == 0
