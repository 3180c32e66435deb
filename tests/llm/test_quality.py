import random
import string

import pytest

from actloom.llm import quality

COMMON = quality.CommonWords.of([("en", w) for w in "the of and to in a is for by on or".split()] + [("ru", w) for w in "и в на с по не".split()] + [("zh", w) for w in "的 在 由 和".split()] + [(None, "x"), ("en", None)])
rnd = random.Random(1)
PROSE = "The review board examines the schedule of annexes for the branch if access was closed. It is kept in the log by day 28 of the month. "
CASES = {
    "prose": [PROSE * 3, PROSE.replace("if ", "if\n") * 3, "\n".join(f"{i}. {PROSE.strip()}" for i in range(1, 6)), PROSE * 4 + "\n- one item\n- two items\n" + PROSE, "决定由煦辰公司的负责人签署。不得无故拒绝！费用为每份79元；每年不超过20元。"],
    "list": ["\n".join(f"- the {w} plan;" for w in "abcdefghij"), "\n".join(f"{i}) the annex {i}x" for i in range(12)), "\n".join(f"{i}.{i} Chapter {'.' * 40} {i * 7}" for i in range(1, 15)), "Heading\n" + "\n".join(f"The {w} inventory" for w in "one two three four five six seven".split())],
    "table": ["\n".join(f"{i}\tthe log\t{i * 31}\t{i * 7}.5" for i in range(9)), "\n".join(f"| {i} | the roll | {i * 5} |" for i in range(9)), "\n".join(f"{i};item;{i * 3},5;{i * 9}" for i in range(9)), "\n".join(f"<tr><td>{i}</td><td>roll</td></tr>" for i in range(9)), "\n".join(f"{i:<6}{'item ' + str(i):<20}{i * 7:>8}" for i in range(9))],
    "junk": ["a" * 200, "the " * 80, "\n".join("".join(rnd.choice("0123456789abcdef") for _ in range(60)) for _ in range(12)), "\n".join('{"id":%d,"k":"ab","v":[1,2]}' % i for i in range(20)), "".join(rnd.choice(string.punctuation + "la1 ") for _ in range(500)), "Home > Login > FAQ > Home > Menu > Login > FAQ > Home > Menu > Search", "© Name 2014\n" * 20],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert quality.describe(text, COMMON)[5] == kind


NAMES = ["Margarete Oberholzer", "Konstantin Wetterling", "Alexandrine Duchesne", "Bartholomew Hargreave", "Theodora Vanderlinden", "Maximilian Rosenkranz"]
ROLES = ["clerk", "head", "judge", "guard", "cook", "aide"]
OFFICES = ["North wing annex", "South tower hall", "East gate chamber", "West court lobby", "Main yard store", "Upper floor study"]


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        # cells of text that stand one to a line
        ("table", "\n".join(x for row in zip(NAMES, ROLES, OFFICES) for x in row)),
        ("table", "\n".join(x for row in zip(NAMES * 2, ROLES[::-1] * 2) for x in row)),
        # levels of items without marks, in lower case and with common words
        ("list", "\n".join(f"the duties of the {a} in the matter of the register and of the annex to it\n    of the {a} for the roll by the order of the board\n    of the {a} on the log or the plan of the year" for a in ROLES)),
        # paragraphs that begin with a blank, and lines that are alike in nothing
        ("prose", "\n".join("   " + PROSE.replace("if ", "if\n").strip() for _ in range(5))),
        ("list", "\n".join("The " + "".join(rnd.choice("abcdef") for _ in range(rnd.randint(4, 30))) for _ in range(24))),
    ],
)
def test_layout_that_comes_back(kind, text):
    assert quality.describe(text, COMMON)[5] == kind


def test_statistics():
    n, mean, symbols, ends, common, _ = quality.describe("The cat of a dog.\nno end\nwhat?", COMMON)
    assert (n, round(mean, 3), symbols, round(ends, 3), round(common, 3)) == (8, 2.625, 0.0, 0.667, 0.375)


def test_period():
    import numpy as np

    assert quality.period(np.array([1, 0, 0] * 8, float)) > 0.9
    assert quality.period(np.ones(20)) == 0.0


def test_table(spark):
    df = spark.createDataFrame([(1, PROSE * 2, "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (1, PROSE * 2, "x"), (5, "x" * 300_000, "x")], "doc_id int, text string, text_kind string")
    got = sorted((r.doc_id, r.n_words, r.text_kind or "") for r in quality.document_stats(df, COMMON).collect())
    assert got == [(1, 54, "prose"), (1, 54, "prose"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 1, "junk")]
    assert quality.document_stats(df.limit(0), COMMON).count() == 0
