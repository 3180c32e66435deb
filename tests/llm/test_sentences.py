import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.llm.sentences import CharacterChain, Model, Segmenter, fit, labelled, observe, split_sentences, train

CUT = Segmenter(Model())


@pytest.mark.parametrize(
    "units",
    [
        ["The fee is EUR 3.71 per copy, i.e. at most EUR 80 per year.", "It is kept by Messrs. Bardek and Lantal Jr.", "See Art. 5 of the Charter."],
        ["Решение подписывает Е. В. Турферов либо иное лицо, указанное в ст. 58 Положения.", "Приём ведётся по адресу: г. Белград, ул. Полная, д. 5.", "Акт от 01.02.2020 г. № 5 хранится до 2021 г.", "Далее."],
        ["«Подлинник выдан.» - так гласит запись.", "В журнале делается отметка: «Подлинник выдан.»", "Как быть?!", "Отказ недопустим!"],
        ["Am 17. Mai 2012 tagt der 8. Ausschuss unter Prof. Ferdan (ca. 47 Pers.).", "Der Wert liegt z. B. unter 135.", "Er gilt."],
        ["À la question « Où est-elle ? » l'autorité répond.", "Le registre porte : « Délai respecté. »", "Que faire ?"],
    ],
)
def test_sentences_with_spaces(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in CUT.units(text)] == units


@pytest.mark.parametrize(
    "units",
    [
        ["“核对无误。”是登记簿的记载。", "登记簿应当写明：“原件已交付。”", "“泓屿”的簿记。", "压力为5.1kPa……", "可以吗？"],
        ["「原本は誰が保管しますか？」と問われたとき、回答する。", "値は1.5%とする。", "認めない！"],
    ],
)
def test_scripts_without_spaces(units):
    text = "".join(units)
    assert [text[a:b] for a, b in CUT.units(text)] == units


@pytest.mark.parametrize(("left", "right"), ["«»", "“”", "„“", "„”", '""', "「」"])
def test_long_quotation(left, right):
    units = [f"The note {left}{'It is kept in the log. ' * 40}It stays{right} is read.", "The rest follows."]
    text = " ".join(units)
    assert [text[a:b] for a, b in CUT.units(text)] == units


def test_layout():
    text = "Title line\nwrapped\n\n1. First item.\n2.1. Second\ngoes on.\na) one;\nb) two:\nc) three\n \nLast"
    assert [text[a:b] for a, b in CUT.units(text)] == ["Title line\nwrapped", "1. First item.", "2.1. Second\ngoes on.", "a) one;", "b) two:", "c) three", "Last"]


def test_characters_without_width():
    text = "One t\u200ewo. \u200bThree\u2060. \u200e\n\nFour"
    assert [text[a:b] for a, b in CUT.units(text)] == ["One t\u200ewo.", "\u200bThree\u2060. \u200e", "Four"]


def test_thai_spaces():
    text = "ห้ามปฏิเสธ ผู้รับจ้างต้องแนบ 51 วัน นับแต่วันแจ้ง (ก) ด้วย"
    assert [text[a:b] for a, b in CUT.units(text)] == ["ห้ามปฏิเสธ", "ผู้รับจ้างต้องแนบ 51 วัน", "นับแต่วันแจ้ง (ก) ด้วย"]


def test_hindi_and_arabic():
    text = "“क्या अवधि बढ़ सकती है?” पूछने पर उत्तर देता है। शुल्क रु. 20.90 है। لا رفض بلا سبب! يوقع د. مودسال أو من ينوب."
    assert len(CUT.units(text)) == 4


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB1 .\n!?«»\"“”。กข)(;:​")), max_size=60))
def test_units_cover_all_but_white_space(text):
    units = CUT.units(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in units)
    covered = [c for a, b in units for c in range(a, b)]
    assert len(set(covered)) == len(covered)
    assert {i for i, c in enumerate(text) if not c.isspace()} <= set(covered)


def test_held_out_accuracy(spark):
    """Boundaries that the layout shows: sentences of clean lines, joined into one paragraph."""
    good = [("The %s is kept by Dr. B. G. Zimpol." % w, w) for w in ("log", "roll", "list", "plan")] + [("See Sec. %d of Vol. III for it." % i, i) for i in range(40)]
    df = spark.createDataFrame([(i, s + "\n\n" + s) for i, (s, _) in enumerate(good)], "id int, t string")
    cut = Segmenter(train(df, "t"))
    text = " ".join(s for s, _ in good)
    assert len(cut.units(text)) == len(good)


def test_all_texts_are_counted(spark):
    """A word that stands in 5 of 6,000 texts is learnt, with all of its places."""
    rows = [(i, f"Item {i} is kept. See qvx. {i}" if i % 1200 == 0 else f"Item {i} is kept.") for i in range(6000)]
    model = train(spark.createDataFrame(rows, "id int, t string"), "t")
    assert model.words["qvx"] == (5, 0, 0)
    assert model.words["kept"] == (0, 5995, 5)


def test_what_is_learnt_outweighs_the_lists(spark):
    """An abbreviation of no list and a listed one that is a word here, both met often before small letters or at ends."""
    rows = [(i, f"See qvx. {i} and qvx. it.\n\nThe plan is at the tab.") for i in range(300)]
    cut = Segmenter(train(spark.createDataFrame(rows, "id int, t string"), "t"))
    units = ["It is kept by qvx. Bardek for now.", "It is at the tab.", "Roll two."]
    text = " ".join(units)
    assert [text[a:b] for a, b in cut.units(text)] == units
    assert [text[a:b] for a, b in Segmenter().units(text)] != units


def test_letters_by_the_word_before_them():
    """A letter ends sentences after one word and is an abbreviation after others; no list says so."""
    texts = [f"It is kept in box k. {w} and in lot q. k. Then {w} goes on.\n\nIt {w} ends in lot q. k.\n\nThe roll of box k. Zim{w} is {w}." for w in ("long", "short", "old", "new") for _ in range(20)]
    model = Model()
    for text in texts:
        for kind, word, which in observe(text):
            counts = model.words if kind == "word" else model.starters
            counts[word] = tuple(n + (i == which) for i, n in enumerate(counts.get(word, (0, 0, 0) if kind == "word" else (0, 0))))
    fit(labelled(texts, model), model)
    units = ["See lot q. k.", "Box k. Zimzim is full.", "The end."]
    text = " ".join(units)
    assert [text[a:b] for a, b in Segmenter(model).units(text)] == units


def test_scripts_without_punctuation():
    """Held-out stretches of a small grammar without marks: at least nine of ten boundaries, and of ten cuts nine right."""
    rnd = random.Random(3)
    who, what, end = ["申請人", "機関長", "担当者", "委員会"], ["書面", "記録", "計画書", "台帳", "通知"], ["を提出する", "を確認した", "を保存する", "は無効である"]
    run = lambda: ["".join((rnd.choice(who), "は", rnd.choice(what), rnd.choice(end))) for _ in range(6)]
    chain = CharacterChain.fit([run() for _ in range(150)])
    good = cut = wanted = 0
    for _ in range(40):
        held, at = run(), 0
        want = {at := at + len(x) for x in held[:-1]}
        got = set(chain.decode("".join(held)))
        good, cut, wanted = good + len(got & want), cut + len(got), wanted + len(want)
    assert good >= 0.9 * wanted and good >= 0.9 * cut
    text = "".join(run() + run() + run())
    assert len(Segmenter(Model(unspaced=chain)).units(text)) > 10
    assert len(Segmenter(Model(unspaced=chain)).units(text[:8])) == 1 and len(Segmenter().units(text)) == 1


def test_table(spark):
    df = spark.createDataFrame([(1, "One two. Three.", "x"), (1, "One two. Three.", "x"), (2, "", "x"), (3, None, "x"), (4, " \n ", "x")], "id int, t string, char_start string")
    got = sorted((r.id, r.char_start, r.char_end) for r in split_sentences(df, "id", "t", Model()).collect())
    assert got == [(1, 0, 8), (1, 9, 15)]
    assert split_sentences(df.limit(0), "id", "t", Model()).count() == 0
    assert train(df.limit(0), "t").starters == {}
