import random

from pyspark.sql import functions as F

from actloom.llm import grouped_split as gs


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


def test_components_against_union_find(spark):
    rnd = random.Random(7)
    edges = [(f"v{rnd.randrange(150)}", f"v{rnd.randrange(150)}") for _ in range(110)] + [(f"chain{i}", f"chain{i + 1}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(60)]
    df = spark.createDataFrame([(ns, a, b) for ns in ("x", "y") for a, b in edges] + [("x", None, "v1"), ("x", "v1", None)], "ns string, a string, b string")
    got = {}
    for r in gs.contract(df).collect():
        assert got.setdefault((r.ns, r.node), r.root) == r.root
    want = roots([(a, b) for a, b in edges if a != b])
    for ns in ("x", "y"):
        mine = {n: root for (k, n), root in got.items() if k == ns}
        assert set(mine) == set(want)
        assert len(set(zip(mine.values(), (want[n] for n in mine)))) == len(set(want.values())) == len(set(mine.values()))


def test_no_edges(spark):
    assert gs.contract(spark.createDataFrame([("x", "a", "a")], "ns string, a string, b string")).count() == 0


ROWS = [
    ("s1", "e1", "train", "doc-1", "p1", "k"), ("s1", "e2", "test", " DOC-1\t", "p2", "k"), ("s1", "e3", "train", None, "p2", "k"), ("s1", "e4", "test", " ", "P2 ", "k"), ("s1", "e5", "test", None, None, "k"),
    ("s1", "e6", "train", "", "", "k"), ("s2", "e1", "train", "d1", "q1", "k"), ("s2", "e2", "train", "d2", "q1", "k"), ("s2", "e3", "test", "d2", "q2", "k"), ("s2", "e4", "test", "d9", None, "k"), ("s2", "e5", None, "d9", None, "k"), ("s3", "e1", "train", "d1", "q", "k"),
]
KIND = "split_strategy string, example_id string, split string, document_id string, pair_id string, group_key string"
PLANS = [gs.Strategy("s1", ("document_id",), stand_ins={"document_id": "pair_id"}), gs.Strategy("s2", ("document_id", "pair_id"))]


def test_parted_groups(spark):
    df = spark.createDataFrame(ROWS, KIND)
    grouped = gs.with_groups(df, PLANS)
    assert sorted(grouped.columns) == sorted(df.columns) and grouped.count() == 11
    got = {(r.split_strategy, r.example_id) for r in gs.parted_groups(grouped).collect()}
    assert got == {("s1", "e1"), ("s1", "e2"), ("s1", "e3"), ("s1", "e4"), ("s2", "e1"), ("s2", "e2"), ("s2", "e3"), ("s2", "e4"), ("s2", "e5")}
    assert gs.with_groups(df.limit(0), PLANS).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rnd = random.Random(2)
    rows = [("s", f"e{i}", "train", f"d{min(rnd.randrange(900), rnd.randrange(900))}" if i % 3 else "hot", None, "k") for i in range(3000)]
    plan = [gs.Strategy("s", ("document_id",), (0.6, 0.25, 0.15), 9)]
    grouped = gs.with_groups(spark.createDataFrame(rows, KIND), plan)
    given = gs.assign(grouped, plan)
    assert given.groupBy("group_key").count().where("count > 1").count() == 0
    n = {r.assigned: r.n for r in grouped.join(given, ["split_strategy", "group_key"]).groupBy("assigned").agg(F.count("*").alias("n")).collect()}
    assert abs(n["train"] / 3000 - 0.6) < 0.01 and abs(n["validation"] / 3000 - 0.25) < 0.01
    assert gs.assign(grouped.limit(0), plan).count() == 0


def test_assignment_is_by_cumulative_weight(spark):
    """Two fields, groups of all weights: every group where the middle of its stretch lies, the heaviest first."""
    rnd = random.Random(5)
    rows = [("s", f"e{i}", "train", f"d{int(rnd.paretovariate(0.5)) % 1500}", f"p{rnd.randrange(6000)}" if i % 9 == 0 else None, "k") for i in range(4000)]
    plan = [gs.Strategy("s", ("document_id", "pair_id"), (0.5, 0.3, 0.2), 3)]
    grouped = gs.with_groups(spark.createDataFrame(rows, KIND), plan)
    given = {r.group_key: r.assigned for r in gs.assign(grouped, plan).collect()}
    sizes = {r.group_key: r["count"] for r in grouped.groupBy("group_key").count().collect()}
    assert set(given) == set(sizes) and sum(sizes.values()) == 4000
    by_split = {s: sorted(sizes[g] for g in given if given[g] == s) for s in gs.SPLITS}
    assert min(by_split["train"] or [0]) >= max(by_split["validation"] or [0]) >= min(by_split["validation"] or [0]) >= max(by_split["test"] or [0])
    at, bounds = 0, {"train": 2000, "validation": 3200, "test": 4000}
    for s in gs.SPLITS:
        at += sum(by_split[s])
        assert abs(at - bounds[s]) <= max(sizes.values()) / 2
