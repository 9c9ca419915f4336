import pytest

from combirisk.operators import iterative as I
from combirisk.operators import models as M
from combirisk.operators import network as N
from combirisk.operators import profiles as A
from combirisk.operators import statistics as S
from combirisk.operators import traversal as T
from combirisk.operators.pairs import symmetric
from combirisk.session import cut_lineage


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_metrics(edges):
    m = {r["item"]: r for r in N.node_metrics(edges, T.betweenness(edges, T.first_sources(edges))).collect()}
    assert m["c"]["degree"] == 3 and m["c"]["degree_centrality"] == 0.75
    assert m["a"]["weighted_degree"] == 1.0 and m["a"]["severity_profile"] == 0.85
    assert all(0 <= r["pri"] <= 1 for r in m.values())
    assert sum(r["degree"] for r in m.values()) == 2 * edges.count()


def test_betweenness_all_sources(edges):
    got = as_dict(T.betweenness(edges, T.first_sources(edges, None)), "item", "betweenness")
    # Ordered pair counts: c carries 8, d carries 6.
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0, "d": 0.75, "e": 0.0}


def test_betweenness_follows_the_definition(spark):
    """Several groups of sources, several shortest paths of one pair, a part of its own and a repeated edge."""
    rows = [(i, (i * step + 1) % 80) for step in (1, 3) for i in range(80)] + [(200, 201), (201, 202), (0, 1)]
    rows = [(f"n{min(r):03d}", f"n{max(r):03d}") for r in rows if r[0] != r[1]]
    near = {}
    for a, b in rows:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = dict.fromkeys(near, 0.0)
    for source in near:
        dist, sigma, order = {source: 0}, {source: 1.0}, [source]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            want[w] += delta[w] if w != source else 0.0
    frame = spark.createDataFrame(rows, "a string, b string")
    top = max(want.values())
    for block in (T.SOURCE_BLOCK, 40):
        got = as_dict(T.betweenness(frame, T.first_sources(frame, None), block=block), "item", "betweenness")
        assert got == pytest.approx({k: v / top for k, v in want.items()})


def test_distances(edges):
    reached = T.distances(T.walk_levels(cut_lineage(symmetric(edges.select("a", "b"))), T.first_sources(edges, None)))
    row = T.path_statistics(reached).first()
    assert row["diameter"] == 3 and row["pairs"] == 20 and row["average_path_length"] == 1.7
    close = as_dict(T.closeness(reached, 5), "item", "closeness")
    assert close["c"] == pytest.approx(4 / 5)


def test_pagerank_sums_to_one(edges):
    ranks = as_dict(I.pagerank(edges, 50), "item", "pagerank")
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert max(ranks, key=ranks.get) == "c"


def test_clustering_and_components(spark, edges):
    c = as_dict(N.clustering(edges), "item", "clustering")
    assert c["a"] == 1.0 and c["c"] == pytest.approx(1 / 3) and c["e"] == 0.0
    more = edges.select("a", "b").unionByName(spark.createDataFrame([("x", "y")], "a string, b string"))
    assert as_dict(I.components(more), "item", "component") == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}


def test_communities_beat_the_trivial_split(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "pq" for i in range(5) for j in range(i + 1, 5)] + [("p0", "q0")]
    two = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")
    assert I.modularity(two, I.communities(two)).first()["modularity"] > 0.3


def test_complete_graph_has_no_share(spark):
    """Every pair is an edge: no path leads through an item, and the largest sum is 0."""
    names = ["a", "b", "c", "d"]
    pairs = [(x, y, "Major interaction" if x == "a" else "Minor interaction", 7.0 if x == "a" else 1.0) for i, x in enumerate(names) for y in names[i + 1 :]]
    whole = spark.createDataFrame(pairs, "a string, b string, label string, weight double")
    sources = T.first_sources(whole, None)
    assert set(as_dict(T.betweenness(whole, sources), "item", "betweenness").values()) == {0.0}
    metrics = cut_lineage(N.node_metrics(whole, T.betweenness(whole, sources, undefined=float("nan"))))
    assert all(r["betweenness"] != r["betweenness"] and r["pri"] != r["pri"] for r in metrics.collect())
    for method in ("pearson", "spearman"):
        got = {(r["x"], r["y"]): r["r"] for r in S.correlation_matrix(metrics, ["degree_centrality", "weighted_degree", "severity_profile"], method).collect()}
        assert got["degree_centrality", "weighted_degree"] != got["degree_centrality", "weighted_degree"]
        assert got["weighted_degree", "severity_profile"] == pytest.approx(1.0)
    assert [tuple(r) for r in A.histogram(metrics, "pri").collect()] == [(49, 4)]
    scaled = M.standardised(metrics, "item", ["degree_centrality"], constant=float("nan"))
    assert all(r["degree_centrality"] != r["degree_centrality"] for r in scaled.collect())
