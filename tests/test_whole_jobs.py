"""Queries that once took a part of their input, against the whole job on rows where the two differ."""

import __spark_entry__ as entry
import duckdb
from combirisk.operators import network as N
from combirisk.operators import traversal as T
from combirisk.plans import views as V
from combirisk.plans.check_views import with_views
from combirisk.sources import export as X

SF = "/root/testdata/sf0.001"
# Queries that read the index with betweenness from all items.
INDEXED = ["a11_descriptive", "a8_code_distribution", "e19_feature_matrix", "g13_class_communities", "g7_priority_index", "i4_multi_target", "s12_metric_records", "w2_top_per_group"]


def test_index_takes_all_sources(spark):
    """The smallest tables have more items than the first 100 sources."""
    edges = V.edges(spark, SF).select("a", "b", "label", "weight")
    whole = N.node_metrics(edges, T.betweenness(edges, T.first_sources(edges, None), undefined=V.UNDEFINED))
    rounded = lambda df: {r["item"]: (round(r["betweenness"], 9), round(r["pri"], 9)) for r in df.collect()}
    got = rounded(V.item_metrics(spark, SF))
    assert len(got) > V.SOURCES and got == rounded(whole) != rounded(V.sampled_item_metrics(spark, SF))
    pri = {r["item"]: r["pri"] for r in entry.queries()["g7_priority_index"](spark, SF).collect()}
    assert all(abs(pri[i] - p) < 1e-6 for i, (_, p) in got.items())


def test_sql_takes_all_sources():
    checks = entry.oracle_sql()
    assert not [n for n in INDEXED if f"ORDER BY item LIMIT {V.SOURCES}" in checks[n]]
    con = duckdb.connect()
    for name in ("part", "lineitem", "orders", "customer"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    whole, sampled = (dict(con.execute(with_views("SELECT item, round(pri, 9) FROM pri", every)).fetchall()) for every in (True, False))
    assert whole.keys() == sampled.keys() and whole != sampled


def test_graph_records_hold_every_edge(spark):
    nodes = spark.createDataFrame([("x", "drug")], "id string, kind string")
    edges = spark.range(10050).selectExpr("concat('s', id) AS src", "'x' AS dst", "'ddi' AS kind")
    rows = X.graph_records(nodes, edges).groupBy("part").count()
    assert {r["part"]: r["count"] for r in rows.collect()} == {"node": 1, "edge": 10050}
