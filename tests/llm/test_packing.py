from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import packing as P
from loomstone.llm import tokens


def optimum(sizes, capacity):
    best = [(99, 0)] * (1 << len(sizes))
    best[0] = (0, capacity)
    for mask in range(1 << len(sizes)):
        bins, held = best[mask]
        for i, s in enumerate(sizes):
            if not mask >> i & 1:
                new = (bins, held + s) if held + s <= capacity else (bins + 1, s)
                best[mask | 1 << i] = min(best[mask | 1 << i], new)
    return best[-1][0]


@settings(max_examples=60, deadline=None)
@given(st.integers(20, 90), st.lists(st.integers(1, 60), max_size=9))
def test_optimal_on_small_groups(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    packed = P.complete(sizes, capacity, keep=20)
    assert sorted(i for b in packed for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in packed)
    assert len(packed) == optimum(sizes, capacity)


def test_only_nodes_bound_the_search():
    for capacity, sizes, bins in (
        (48, [10, 13, 16, 8, 27, 23, 24, 24, 17, 11, 19], 4),
        (107, [22, 21, 64, 28, 18, 21, 57, 52, 20, 15], 3),
        (93, [54, 32, 23, 33, 44, 11, 50, 49, 28, 15, 31], 4),
        (55, [29, 11, 27, 31, 18, 7, 18, 17, 27, 20, 12], 4),
    ):
        assert len(P.complete(sizes, capacity)) == len(P.complete(sizes, capacity, steps=3, keep=1)) == optimum(sizes, capacity) == bins
        assert len(P.complete(sizes, capacity, nodes=0)) == len(P.best_fit(sizes, capacity))


def test_single_larger_item_replaces():
    ways, _, cut = P.fillings({6: 1, 5: 1, 3: 1, 2: 1}, [2, 3, 5, 6], 9, 10_000, 100, False)
    assert ways == [(6, 3)] and not cut  # in (6, 2) the 3 could stand for the 2, in (5, 3) the 6 for the 5


def test_never_worse_than_best_fit():
    rng = random.Random(5)
    for capacity in (128, 1000):
        sizes = [rng.randint(1, capacity) for _ in range(300)]
        assert P.lower_bound(sizes, capacity) <= len(P.complete(sizes, capacity)) <= len(P.best_fit(sizes, capacity))


def test_texts(spark):
    texts = ["hello world " * n for n in (1, 5, 20, 60, 200, 3, 3)] + ["", None, "多语言 текст " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"part": F.lit("x"), "bin_kind": F.lit("y")})
    bins = spark.createDataFrame([("small", 64), ("large", 256), ("none", 0)], "bin_kind string, capacity_tokens int")
    out = P.pack(df, "doc_id", "text", bins).collect()
    encode = tokens.encoder()
    for kind, capacity in (("small", 64), ("large", 256)):
        rows = [r for r in out if r.bin_kind == kind]
        held: dict[str, int] = {}
        for i, t in enumerate(texts):
            size, parts = len(encode(t or "")), sorted((r.part, r.first_token, r.n_tokens) for r in rows if r.doc_id == i)
            assert sum(p[2] for p in parts) == size
            assert [p[0] for p in parts] == list(range(1, len(parts) + 1))
            assert size > capacity or len(parts) == 1
            assert [p[1] for p in parts] == [sum(q[2] for q in parts[:j]) for j in range(len(parts))]
        for r in rows:
            assert (r.bin_id is None) == (r.n_tokens == 0)
            if r.bin_id:
                held[r.bin_id] = held.get(r.bin_id, 0) + r.n_tokens
        assert max(held.values()) <= capacity
    assert {r.bin_kind for r in out} == {"small", "large"}
    assert P.pack(df.limit(0), "doc_id", "text", bins).collect() == []


def test_little_room_is_left(spark, data):
    packed = P.pack(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{data}/pack_bins.parquet"))
    for r in P.usage(packed).collect():
        assert r.n_bins <= r.least_bins + 2
