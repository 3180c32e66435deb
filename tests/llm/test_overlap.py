import random

import numpy as np

from actloom.llm import overlap as ov


def jaccard(a, b):
    x, y = set(ov.words_of(a)), set(ov.words_of(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(n=240):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            out.append([rnd.choice(words) for _ in range(rnd.randint(5, 40))])
        else:
            t = list(rnd.choice(out))
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(t)
    return [" ".join(t) for t in out]


def test_words():
    assert ov.words_of("Ａb, c​d-12 é_x") == ["ab", "cd", "12", "é", "x"]


def test_index_finds_every_run():
    seqs = [[1, 2, 3, 4], [9, 2, 3, 8], [2, 3, 4, 5, 2, 3]]
    words = np.array(sum(seqs, []), np.uint64)
    offsets = np.cumsum([0, *map(len, seqs)])
    ix = ov.WordIndex.build(words, offsets, [b"a", b"b", b"c"])
    code = ix.code(np.array([2, 3, 4, 77], np.uint64))
    end, there = ix.matches(code, np.zeros(4, np.int64), rare=1, long=3)
    # from word 4 the longest match 2 3 4 stands in texts 0 and 2
    assert {(e, t) for e, t in zip(end.tolist(), there.tolist()) if e == 2} == {(2, 0), (2, 2)}


def test_pairs_against_brute_force(spark, monkeypatch):
    texts = corpus()
    rnd = random.Random(4)
    rows = []
    for i, t in enumerate(texts):
        for s in ("s1", "s2"):
            if rnd.random() < 0.9:
                rows.append((s, f"e{i}", t, rnd.choice(["train", "train", "validation", "test"]), "k"))
    rows += rows[:30] + [("s1", "n1", None, "train", "k"), ("s1", "n2", "", "test", "k"), ("s1", "n3", "one two", "train", "k"), ("s1", "n4", "one two", "test", "k")]
    df = spark.createDataFrame(rows, "s string, id string, text string, split string, key string")
    want = set()
    single = sorted({(s, i, t, p) for s, i, t, p, _ in rows if t and len(set(ov.words_of(t))) >= 5})
    for x in range(len(single)):
        for y in range(x + 1, len(single)):
            (s, i, t, p), (s2, j, u, q) = single[x], single[y]
            if s == s2 and i != j and (p == "train") != (q == "train") and jaccard(t, u) >= 0.8 - 1e-9:
                want.add((s, min(i, j), max(i, j)))
    # several shards and slices
    many = ov.cross_split_overlaps(df, "s", "id", "text", "split").collect()
    monkeypatch.setattr(ov.class_pairs, "__defaults__", (0.8, 900, 40))
    few = ov.cross_split_overlaps(df, "s", "id", "text", "split").collect()
    # so many shards that words name those a text meets; some are cut into pieces
    monkeypatch.setattr(ov.class_pairs, "__defaults__", (0.8, 60, 10))
    routed = ov.cross_split_overlaps(df, "s", "id", "text", "split").collect()
    assert len(want) > 50
    for got in (many, few, routed):
        assert sorted((r.s, r.id_a, r.id_b) for r in got) == sorted(want)


def found_pairs(left, right):
    code = {}
    as_words = lambda ts: (np.array([code.setdefault(w, len(code) * 7919 + 11) for t in ts for w in t.split()], np.uint64), np.cumsum([0, *[len(t.split()) for t in ts]]))
    ix = ov.WordIndex.build(*as_words(right), [bytes([i % 256, i // 256]) for i in range(len(right))])
    return [(i, j) for here, there in ix.overlaps(*as_words(left), 0.8) for i, j in zip(here.tolist(), there.tolist())]


def wanted_pairs(left, right):
    return [(i, j) for i, t in enumerate(left) for j, u in enumerate(right) if jaccard(t, u) >= 0.8 - 1e-9]


def test_family_of_short_variants(monkeypatch):
    """100 texts of 12 words that differ in the word in the middle: every shared run is frequent and short."""
    family = [f"a b c d e f v{i} g h i j k" for i in range(100)]
    for block in (2_000_000, 50):
        monkeypatch.setattr(ov, "BLOCK", block, raising=False)
        assert sorted(found_pairs(family[:60], family[60:])) == [(i, j) for i in range(60) for j in range(40)]


def test_families_of_many_variants(spark, monkeypatch):
    """Families of 17, 100 and 1,000 texts, short and long: all links are found, in one shard and in routed ones."""
    rows = []
    for size in (17, 100, 1000):
        for base in ("a b c d e f {} g h i j k", " ".join(f"w{i} x{i} y{i} z{i} {{}}" for i in range(12))):
            fresh = [f"v{i}" for i in range(size)]
            rows += [(f"{size}{base[0]}{i}", base.format(*[f"{size}{base[0]}{v}"] * 12), "train" if i % 50 else "test") for i, v in enumerate(fresh)]
    df = spark.createDataFrame([("s", *r) for r in rows], "s string, id string, text string, split string")
    sets = [(i, set(ov.words_of(t)), p) for i, t, p in rows]
    tests, trains = [x for x in sets if x[2] == "test"], [x for x in sets if x[2] == "train"]
    want = {(min(i, j), max(i, j)) for i, x, _ in tests for j, y, _ in trains if len(x & y) >= 0.8 * len(x | y) - 1e-9}
    assert len(want) > 20_000
    for words in (2_000_000, 100):
        monkeypatch.setattr(ov.class_pairs, "__defaults__", (0.8, words, 500))
        assert {(r.id_a, r.id_b) for r in ov.cross_split_overlaps(df, "s", "id", "text", "split").collect()} == want


def test_frequent_words_against_brute_force():
    """Few words, many texts, other orders, sizes that differ; a pair comes once."""
    rnd = random.Random(9)
    texts = []
    for _ in range(500):
        t = list(rnd.choice(texts)) if texts and rnd.random() < 0.7 else [f"w{rnd.randrange(40)}" for _ in range(rnd.randint(5, 25))]
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(len(t))] = rnd.choice([f"w{rnd.randrange(40)}", f"x{rnd.randrange(4000)}"])
        rnd.shuffle(t)
        texts.append(t)
    texts = [" ".join(t) for t in texts if len(set(t)) >= 5]
    got = found_pairs(texts[:250], texts[250:])
    assert sorted(got) == wanted_pairs(texts[:250], texts[250:])
    assert len(got) > 200


def test_empty(spark):
    df = spark.createDataFrame([], "s string, id string, text string, split string")
    assert ov.cross_split_overlaps(df, "s", "id", "text", "split").count() == 0


def test_report(spark):
    rows = [("s", "a", "x", "train", "src"), ("s", "b", "x", "test", "src"), ("s", "c", "y", "test", None)]
    df = spark.createDataFrame(rows, "s string, id string, text string, split string, source string")
    pairs = spark.createDataFrame([("s", "a", "b")], "s string, id_a string, id_b string")
    got = {(r.split, r.source, r.n_records, r.n_overlapping) for r in ov.overlap_report(pairs, df, "s", "id", "split", "source").collect()}
    assert got == {("test", "src", 1, 1), ("test", None, 1, 0)}
