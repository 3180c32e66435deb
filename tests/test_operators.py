import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from actloom.functions import entities, rules
from actloom.operators import corpus, integrity, metrics, ml, reporting, search, topk


def test_diversified_pick_takes_one_of_each_first(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("aaabbc")], "p int, i int, kind string")
    got = [r.i for r in topk.diversified(df, ["p"], "kind", ["i"], 5).orderBy("pick").collect()]
    assert got == [0, 3, 5, 1, 4]


def test_pooled_falls_back(spark):
    df = spark.createDataFrame([(1, i, i == 2) for i in range(4)] + [(2, i, False) for i in range(4)], "p int, i int, main boolean")
    got = sorted((r.p, r.i, r.scope, r.n_truncated) for r in topk.pooled(df, ["p"], F.col("main"), ["i"], 5, 2).collect())
    assert got == [(1, 2, "primary", 0), (2, 0, "fallback", 2), (2, 1, "fallback", 2)]


def test_choices_hold_the_answer(spark):
    df = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(["x", "y", "z", "x"])], "p int, pick int, answer string")
    for r in topk.with_choices(df, ["p"], "answer", "pick", ("none",)).collect():
        assert r.choices[r.correct_index] == r.answer and len(set(r.choices)) == len(r.choices) == 3


def test_lexicon(spark):
    pack = rules.Lexicon({"a": ("one",), "b": ("two", "three")}, "none")
    df = spark.createDataFrame([("ONE two three", 1), ("one two", 2), ("", 3), (None, 4)], "t string, i int")
    assert [r.x for r in df.select("i", pack.label(F.col("t")).alias("x")).orderBy("i").collect()] == ["b", "a", "none", "none"]


def test_entities_have_places(spark):
    df = spark.createDataFrame([(1, "в течение 30 рабочих дней см. ст. 5"), (2, None), (3, "")], "id bigint, t string")
    rows = entities.extract(df, ["id"], "t").collect()
    assert {(r.entity_type, r.normalized_value) for r in rows} == {("deadline", "P30_WORKING_DAY"), ("reference", "ст. 5")}
    for r in rows:
        assert "в течение 30 рабочих дней см. ст. 5"[r.start_char : r.end_char] == r.value


def test_entity_merge_prefers_the_surer(spark):
    kind = "id int, " + entities.ENTITY
    a = spark.createDataFrame([(1, "t", "v", "n", 0, 1, 0.9, "rules")], kind)
    b = spark.createDataFrame([(1, "t", "v", "n", 0, 1, 0.9, "other"), (1, "t", "w", "m", 3, 4, 0.1, "other")], kind)
    assert sorted(r.extraction_method for r in entities.merge(a, b, ["id"]).collect()) == ["other", "other"]


def test_graded_attempts(spark):
    df = spark.createDataFrame([(1, True, True), (1, False, True), (1, True, False), (2, None, False)], "a int, ok boolean, given boolean")
    got = {r.a: (r.n_correct, r.n_wrong, r.n_unanswered, r.percent, r.passed) for r in reporting.graded(df, ["a"], F.col("ok"), F.col("given")).collect()}
    assert got == {1: (1, 1, 1, 33.33, False), 2: (0, 0, 1, 0.0, False)}


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id bigint, v array<double>").repartition(5)
    got = {}
    for r in search.nearest(df.where("id % 20 = 0"), df, "id", "v", 3, block=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert [got[q][k] for k in (1, 2, 3)] == np.lexsort((np.arange(60), -s))[:3].tolist()
    assert search.nearest(df.limit(0), df, "id", "v", 3).count() == 0


def test_first_wins(spark):
    a = spark.createDataFrame([("k1", 1)], "k string, v int")
    b = spark.createDataFrame([("k1", 2), ("k2", 3)], "k string, v int")
    assert sorted((r.k, r.v, r.source_rank) for r in corpus.union_first_wins([a, b], "k").collect()) == [("k1", 1, 0), ("k2", 3, 1)]


def test_splits_keep_groups_and_shares(spark):
    df = spark.createDataFrame([(i, f"g{i % 10}", "xy"[i % 2]) for i in range(200)], "id int, g string, l string")
    out = corpus.group_split(df, "g", "l", 0.3)
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    s = corpus.stratified_split(df, "l", "id", 0.25)
    assert {r.n for r in s.where("split = 'test'").groupBy("l").agg(F.count("*").alias("n")).collect()} == {25}
    leaks = corpus.leakage(df.withColumn("ns", F.lit(1)).withColumn("split", F.when(F.col("id") < 100, "a").otherwise("b")), "ns", "split", "g").first()
    assert leaks.n_shared == 10


def greedy(rows, share):
    """The rule of group_split over (group, label) rows, group after group."""
    groups, overall = {}, Counter(x for _, x in rows)
    for g, x in rows:
        groups.setdefault(g, Counter())[x] += 1
    target, taken, out = max(1, round(len(rows) * share)), Counter(), set()
    top = lambda c: max(c.items(), key=lambda kv: (kv[1], kv[0]))[0]
    for g in sorted(groups, key=lambda g: (-groups[g].total(), overall[top(groups[g])], g)):
        if taken.total() >= target:
            break
        then, size = taken + groups[g], groups[g].total()
        if then.total() <= target + max(1, size // 2) or sum(abs(then[x] / target - overall[x] / len(rows)) for x in overall) < 0.3:
            out.add(g)
            taken = then
    return out


@pytest.mark.parametrize("seed", range(5))
def test_group_split_is_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"g{min(rnd.randrange(60), rnd.randrange(60), rnd.randrange(9 + 10 * seed))}", rnd.choice("aab" if seed % 2 else "abcd")) for _ in range(500)]
    rows += [("hot", "a")] * (200 * seed)
    got = corpus.group_split(spark.createDataFrame(rows, "g string, l string").repartition(5), "g", "l", 0.15 + 0.05 * seed)
    assert {r.g for r in got.where("split = 'test'").collect()} == greedy(rows, 0.15 + 0.05 * seed)
    assert got.count() == len(rows)


def test_group_split_of_nothing(spark):
    assert corpus.group_split(spark.createDataFrame([(None, "a")], "g string, l string"), "g", "l", 0.2).count() == 0


def test_label_minimums_and_nearest(spark):
    df = spark.createDataFrame([(f"e{i:03}", "ab"[i % 2], "train" if i > 3 else "test") for i in range(60)], "id string, l string, split string")
    out = corpus.label_minimums(df, "l", "id", "test", "train", 5)
    assert {(r.l, r.id) for r in out.where("split = 'test'").collect()} == {("ab"[i % 2], f"e{i:03}") for i in range(10)} and out.count() == 60
    rnd = random.Random(1)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(120, None)]
    v = spark.createDataFrame(vectors, "id bigint, v array<double>")
    few = {(r.query_id, r.id, r["rank"]) for r in search.nearest(v.where("id % 20 = 0"), v, "id", "v", 3).collect()}
    assert len(few) == 18 and few == {(r.query_id, r.id, r["rank"]) for r in search.nearest(v.where("id % 20 = 0"), v, "id", "v", 3, block=2, slice_rows=17).collect()}


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (1, None, "b")], "m int, t string, p string")
    cells = metrics.confusion(df, ["m"], "t", "p")
    got = {r.label: (r.precision, r.recall, r.f1) for r in metrics.per_class(cells, ["m"], "t", "p").collect()}
    assert got == {"a": (1.0, 0.5, 0.6667), "b": (0.5, 1.0, 0.6667)}
    assert metrics.summary(metrics.per_class(cells, ["m"], "t", "p"), ["m"]).first().accuracy == 0.6667
    auc = spark.createDataFrame([(1, True, 0.9), (1, True, 0.5), (1, False, 0.5), (1, False, 0.1)], "m int, t boolean, s double")
    assert metrics.roc_auc(auc, ["m"], F.col("t"), "s").first().auc == 0.875


def test_contained_matches_use_each_once(spark):
    e = spark.createDataFrame([(1, 1, "ab"), (1, 2, "ab"), (1, 3, "zz")], "k int, expected_id int, text string")
    f = spark.createDataFrame([(1, 10, "xxabxx"), (1, 11, "abx")], "k int, found_id int, text string")
    assert sorted((r.expected_id, r.found_id) for r in metrics.contained_matches(e, f, "k").collect()) == [(1, 11), (2, 10)]


def test_violations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (2, None)], "a int, b int")
    assert [(r.key, r.detail) for r in integrity.duplicates(df, "r", ["a", "b"]).collect()] == [("1/1", "2 rows")]


def test_hybrid_ladder(spark):
    df = spark.createDataFrame([("critical", "editorial", 0.9), ("editorial", "critical", 0.8), ("editorial", "critical", 0.5), ("important", "editorial", 0.9), ("informational", "editorial", 0.65)], "r string, m string, p double")
    got = [r.h for r in df.select(ml.hybrid(F.col("r"), F.col("m"), F.col("p")).alias("h")).collect()]
    assert got == ["critical", "critical", "editorial", "important", "editorial"]


def test_model_learns_and_guards(spark):
    rows = [("deadline of 30 days", "a")] * 12 + [("see the annex", "b")] * 12
    df = spark.createDataFrame(rows, "t string, l string")
    model = ml.fit(df, "t", "l")
    assert {(r.l, r.ml_label) for r in ml.predict(model, df, "t", "l").collect()} == {("a", "a"), ("b", "b")}
    assert ml.fit(df.limit(3), "t", "l") is None


def test_session_searches_take_all_queries(spark):
    from actloom import catalog

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in catalog.QUERIES["K10_session_searches"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add((r.vec_id, r.distance))
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0 and embedding is not null").collect()}
    assert set(got) == ids and all(len(x) == 10 for x in got.values())
    assert got[0] == {(r.vec_id, r.distance) for r in catalog.QUERIES["K10_session_search"](spark, sf).collect()}
