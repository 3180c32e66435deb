import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actloom.llm import packing


def best_fit(sizes, capacity):
    """One item at a time, the longest first, into the fullest bin it fits."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= size
        else:
            room.append(capacity - size)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40)))
def test_plan_holds_every_item_within_capacity(counts):
    slots, bins = packing.plan_slots(counts, 30)
    load = {}
    for length, n in counts.items():
        own = sorted((s for s in slots if s.length == length), key=lambda s: s.first_rank)
        for rank in range(n):
            s = [x for x in own if x.first_rank <= rank][-1]
            b = s.first_bin + (rank - s.first_rank) // s.per_bin
            load[b] = load.get(b, 0) + length
    assert all(v <= 30 for v in load.values()) and sorted(load) == list(range(bins))
    assert bins == best_fit([k for k, n in counts.items() for _ in range(n)], 30)


def test_length_beyond_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.plan_slots({31: 1}, 30)


def test_documents_are_whole_or_in_spans(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_PART_ROWS", 50)  # several parts per length
    rnd = random.Random(5)
    sizes = [7] * 300 + [rnd.randint(1, 20) for _ in range(200)] + [45, 20, 40, 0, 0]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(900, None, "x"), (901, -3, "x"), (5, 7, "x")], "doc_id bigint, n_tokens int, rank string")
    rows = packing.pack(df, 20).collect()
    load, spans = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.part, r.size_start, r.size_end))
        if r.container_id is not None:
            load[r.container_id] = load.get(r.container_id, 0) + r.size_end - r.size_start
    assert max(load.values()) <= 20 and sum(load.values()) == sum(sizes) + 7
    cut = [x for n in [*sizes, 7] for x in ([20] * (n // 20) + [n % 20])]
    assert len(load) == best_fit([x for x in cut if x], 20)
    assert sorted(spans[500]) == [(0, 0, 20), (1, 20, 40), (2, 40, 45)] and sorted(spans[502]) == [(0, 0, 20), (1, 20, 40)]
    assert spans[503] == spans[900] == spans[901] == [(0, 0, 0)]
    assert len(spans[5]) == 2  # a repeated row is an item of its own


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), 10).count() == 0
