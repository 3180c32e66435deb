from pyspark.sql import functions as F

from actloom.operators import chunking, pages

ACT = """Положение о порядке

Преамбула говорит о многом, и потому она длинная.

Раздел I. Общее
Глава 1. Сроки
Статья 1. Порядок
1. Первый пункт.
1) подпункт один
а) подпункт буква
продолжение
Статья 2
Тело статьи без пунктов.
2. Пункт второй."""


def test_chunks_of_an_act():
    rows = chunking.chunk(ACT)
    kinds = [r[1] for r in rows]
    assert kinds == ["title", "preamble", "point", "subpoint", "subpoint", "article", "point"]
    point, sub, letter, article = rows[2], rows[3], rows[4], rows[5]
    assert point[5] == "section:i/chapter:1/article:1/point:1"
    assert sub[5] == "section:i/chapter:1/article:1/point:1/subpoint:1" and sub[6] == "Статья 1: Порядок · Пункт 1 · Подпункт 1"
    assert letter[8] == "подпункт буква\nпродолжение"
    assert article[5] == "section:i/chapter:1/article:2" and article[8] == "Тело статьи без пунктов."
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))


def test_first_bracket_is_a_point():
    rows = chunking.chunk("1) раз\n2) два")
    assert [(r[1], r[3]) for r in rows] == [("point", "1)"), ("subpoint", "2)")]


def test_fallback_joins_short_blocks():
    rows = chunking.chunk("x" * 90 + "\n\nкоротко\n\n" + "y" * 90)
    assert [r[1] for r in rows] == ["fallback_block"] * 2
    assert rows[0][8] == "x" * 90 + "\n\nкоротко"


def test_soft_limit_closes_a_heading_fragment():
    body = "\n".join(["слово " * 40] * 7)
    rows = chunking.chunk(f"Статья 1\n{body}\n- пункт списка\nостаток")
    assert [r[1] for r in rows] == ["article", "article"]
    assert rows[1][8] == "остаток"


def test_pieces_are_packed():
    text = "\n\n".join(["a" * 1000, "b" * 1000, "c" * 1000])
    assert [len(p) for p in chunking.pieces(text)] == [2002, 1000]
    assert chunking.pieces("z" * 5000) == ["z" * 5000]
    rows = chunking.chunk("1. " + text)
    assert [r[5] for r in rows] == ["point:1#part-1", "point:1#part-2"]


def test_chunk_documents_skips_nulls_and_keeps_keys(spark):
    df = spark.createDataFrame([(1, "1. a", "x"), (2, None, "x"), (3, "  ", "x"), (4, "b", "x")], "id bigint, t string, text string")
    rows = chunking.chunk_documents(df, ["id"], "t").collect()
    assert {(r.id, r.text) for r in rows} == {(1, "a"), (4, "b")}
    assert chunking.chunk_documents(df.limit(0), ["id"], "t").count() == 0


def test_line_context_matches_a_fold(spark):
    df = spark.createDataFrame([(1, ACT), (2, None)], "id bigint, t string")
    got = {r.line_no: (r.kind, r.section_line, r.chapter_line, r.article_line, r.point_line) for r in chunking.line_context(df, "id", "t").collect()}
    assert got[7] == ("point", 4, 5, 6, 7)
    assert got[8] == ("subpoint", 4, 5, 6, 7)
    assert got[11] == ("article", 4, 5, 11, None)
    assert got[13] == ("point", 4, 5, 11, 13)


def test_pages(spark):
    text = "\f".join(f"ШАПКА ДОКУМЕНТА\nтекст страницы {i} идёт дальше и даль-\nше и не кончается раз {i}\nна этой строке {i}.\n{i}" for i in (1, 2, 3))
    df = spark.createDataFrame([(1, text), (2, "одна страница")], "id bigint, t string")
    edges = {(r.edge, r.line) for r in pages.repeated_edges(pages.page_lines(df, "id", "t"), "id").collect()}
    assert ("top", "ШАПКА ДОКУМЕНТА") in edges
    clean = {r.id: r.normalized_text for r in pages.clean_pages(df, "id", "t").collect()}
    assert "ШАПКА" not in clean[1] and "дальше и не кончается" in clean[1] and "\n1\n" not in clean[1]
    assert clean[2] == "одна страница"


def test_dehyphenate(spark):
    df = spark.createDataFrame([("сло-\nво и 2-\nA",)], "t string")
    assert df.select(pages.dehyphenate(F.col("t")).alias("r")).first().r == "слово и 2-\nA"
