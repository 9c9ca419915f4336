import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from combirisk.operators import attributes as A
from combirisk.operators import pairs as P
from combirisk.operators import traversal as T
from combirisk.session import cut_lineage


def drawn(spark, seed=3):
    draw = random.Random(seed)
    items = [f"i{k:02d}" for k in range(14)]
    held = {i: {f"t{draw.randrange(40):02d}" for _ in range(draw.randrange(12))} | ({"all"} if draw.random() < 0.7 else set()) for i in items}
    lists = {r: draw.sample(items, draw.randrange(1, 9)) for r in range(40)}
    regimens = spark.createDataFrame([(r, i) for r, members in lists.items() for i in members], "regimen_id int, item string")
    attributes = spark.createDataFrame([(i, t) for i, ts in held.items() for t in ts], "item string, attr string")
    return held, lists, regimens, attributes


@pytest.mark.parametrize("limit, most", [(64, 64), (3, 64), (64, 1), (3, 3)])
def test_overlaps_by_every_road(spark, limit, most):
    held, lists, regimens, attributes = drawn(spark)
    want = {}
    for r, members in lists.items():
        for a, b in combinations(sorted(members), 2):
            shared = sorted(held[a] & held[b])
            if shared:
                want[r, a, b] = (len(shared), "|".join(shared[:2]))
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank_") <= 2, F.col("attr")))), "|").alias("names")
    got = P.regimen_overlaps(regimens, attributes, F.count(F.lit(1)).alias("n"), names, ranked=True, limit=limit, most=most)
    assert {(r["regimen_id"], r["a"], r["b"]): (r["n"], r["names"]) for r in got.collect()} == want


def test_packed_sets_meet_once(spark):
    held, _, _, attributes = drawn(spark)
    pairs = spark.createDataFrame(list(combinations(sorted(held), 2)), "a string, b string")
    for size in (1, 3, 1024):
        got = sorted(tuple(r) for r in P.common_triples(pairs, attributes, size).collect())
        assert got == sorted((a, b, t) for a, b in combinations(sorted(held), 2) for t in held[a] & held[b])


@pytest.mark.parametrize("most", [1, 3, 64])
def test_shared_counts_and_similarity(spark, most):
    held, _, _, attributes = drawn(spark, 7)
    asked = [p for k, p in enumerate(combinations(sorted(held), 2)) if k % 3]
    pairs = spark.createDataFrame(asked, "a string, b string")
    got = {(r["a"], r["b"]): r["n_shared"] for r in P.shared_counts(pairs, attributes, most).collect()}
    assert got == {(a, b): len(held[a] & held[b]) for a, b in asked if held[a] & held[b]}
    near = {(r["a"], r["b"]): r["s"] for r in A.pair_similarity(pairs, attributes, "s").collect()}
    assert near == {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in asked if held[a] and held[b]}


def test_shared_by_members(spark):
    held, lists, regimens, attributes = drawn(spark, 5)
    counted = {r: {t: sum(t in held[i] for i in members) for i in members for t in held[i]} for r, members in lists.items()}
    two = {(r, t, n) for r, ts in counted.items() for t, n in ts.items() if n >= 2}
    every = {(r, t, n) for r, ts in counted.items() for t, n in ts.items() if n == len(lists[r])}
    assert {tuple(r) for r in A.shared_by_members(regimens, attributes).select("regimen_id", "attr", "n_items").collect()} == two
    assert {tuple(r) for r in A.shared_by_members(regimens, attributes, every=True).select("regimen_id", "attr", "n_items").collect()} == every


@pytest.mark.parametrize("words", [1, 2])
def test_bits_count_what_rows_of_distances_do(spark, words):
    """A hub, a chain and a part of its own, in several blocks of sources."""
    edges = [("hub", f"n{k:03d}") for k in range(150)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(12)] + [("hub", "c00"), ("x", "y")]
    frame = spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")
    want = T.sums_of(T.distances(T.walk_levels(cut_lineage(P.symmetric(frame)), T.first_sources(frame, None))))
    got = T.distance_sums(frame, words)
    assert sorted(map(tuple, got.select("item", "total", "reached", "far").collect())) == sorted(map(tuple, want.select("item", "total", "reached", "far").collect()))
    assert T.path_statistics(got).first()["diameter"] == 14


def test_betweenness_in_blocks(spark, edges):
    whole = sorted(map(tuple, T.betweenness(edges, T.first_sources(edges, None)).collect()))
    parts = sorted(map(tuple, T.betweenness(edges, T.first_sources(edges, None), block=2).collect()))
    assert [p[0] for p in parts] == [w[0] for w in whole]
    assert all(abs(p[1] - w[1]) < 1e-12 for p, w in zip(parts, whole))
