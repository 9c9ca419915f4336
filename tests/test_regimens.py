import pytest
from pyspark.sql import functions as F

from combirisk.operators import alternatives as R
from combirisk.operators import attributes as A
from combirisk.operators import network as N
from combirisk.operators import regimen as H
from combirisk.operators import traversal as T
from combirisk.operators import resolve as S
from combirisk.operators.pairs import regimen_edges, shared_attributes


@pytest.fixture(scope="module")
def regimens(spark):
    rows = [("r1", x) for x in "abc"] + [("r2", x) for x in "abcde"] + [("r3", "e")]
    return spark.createDataFrame(rows, "regimen_id string, item string")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_lists_agree_with_short_ones(regimens, edges):
    pairs = edges.select("a", "b")
    assert rows_of(regimen_edges(regimens, pairs, limit=2)) == rows_of(regimen_edges(regimens, pairs, limit=64))
    assert regimen_edges(regimens, pairs).count() == 8


def test_salted_overlap_agrees(spark, regimens):
    attrs = spark.createDataFrame([(x, y) for x in "abcde" for y in ("p", "q") if (x, y) != ("c", "q")], "item string, attr string")
    assert rows_of(shared_attributes(regimens, attrs, limit=1)) == rows_of(shared_attributes(regimens, attrs, limit=64))


def test_network_risk(spark, regimens, edges):
    tagged = edges.withColumn("phenotypes", F.array(F.lit("bleeding")))
    out = {r["regimen_id"]: r for r in H.network_risk(regimens, regimen_edges(regimens, tagged), N.node_metrics(edges, T.betweenness(edges, T.first_sources(edges)))).collect()}
    assert out["r1"]["risk_level"] == "CRITICAL" and out["r1"]["interactions"] == 3 and out["r1"]["phenotypes"] == 1
    assert out["r3"]["interactions"] == 0 and out["r3"]["risk_level"] == "LOW"


def test_decomposition_adds_up(spark, regimens, edges):
    attrs = spark.createDataFrame([("a", "p"), ("b", "p")], "item string, attr string")
    alts = spark.createDataFrame([("b", 3)], "item string, n int")
    d = H.decompose(regimens, edges, attrs, attrs, alts)
    for r in d.groupBy("regimen_id").agg(F.sum("share").alias("s")).collect():
        assert r["s"] == pytest.approx(100.0, abs=1e-4)
    assert d.filter("a = 'a' and b = 'b'").first()["replace"] == "b"


def test_lower_index_range_is_exact(spark, regimens, edges):
    metrics = N.node_metrics(edges, T.betweenness(edges, T.first_sources(edges)))
    targets = spark.createDataFrame([("r1", "c"), ("r2", "c")], "regimen_id string, target string")
    index = metrics.select("item", F.round("pri", 9).alias("pri"))
    low = targets.join(index.select(F.col("item").alias("target"), F.col("pri").alias("target_pri")), "target").join(index, F.col("pri") < F.col("target_pri"))
    every = R.not_members(low.select("regimen_id", "target", "item", "pri", "target_pri"), regimens)
    assert rows_of(R.lower_index_alternatives(targets, regimens, edges, metrics)) == rows_of(R._link_scored(every, targets, regimens, edges, F.lit(0.4), 5))


def test_nearest_blocks_agree(spark):
    rows = [(f"i{n}", [float(n % 7), float(n % 5), 1.0]) for n in range(40)]
    vectors = spark.createDataFrame(rows, "item string, vector array<double>")
    assert rows_of(R.nearest(vectors, 3, block=8)) == rows_of(R.nearest(vectors, 3, block=100))


def test_group_members_salted(spark, monkeypatch):
    groups = spark.createDataFrame([(f"i{n}", "k") for n in range(9)], "item string, key string")
    targets = spark.createDataFrame([("i1",)], "target string")
    monkeypatch.setattr(A, "GROUP_SALT_SIZE", 2)
    assert A.group_members(targets, groups).count() == 8


def test_fuzzy_blocking_equals_brute_force(spark):
    words = ["warfarin", "heparin", "abc", "abd", "ab", "a", "zyx", "aspirin", "asprin", "cab", "bac"]
    names = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r["query"], r["name"]) for r in S.fuzzy_matches(names.select(F.col("name").alias("query")), names, k=100).collect()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    assert got == {(a, b) for a in words for b in words if 1 - edit(a, b) / max(len(a), len(b)) >= 0.6 - 1e-9}


def test_resolution_cascade(spark):
    inputs = spark.createDataFrame([("D1",), ("ALPHA ",), ("al",), ("beta drug oral",), ("zz",), ("al1",)], "input string")
    items = spark.createDataFrame([("D1", "alpha"), ("D2", "beta drug")], "drug_id string, item string")
    aliases = spark.createDataFrame([("al1", "beta drug")], "alias string, name string")
    got = {r["input"]: (r["item"], r["method"]) for r in S.resolve_names(inputs, items, aliases).collect()}
    assert got["D1"] == ("alpha", "id") and got["ALPHA "] == ("alpha", "name") and got["al1"] == ("beta drug", "alias")
    assert got["al"] == ("alpha", "contains") and got["beta drug oral"] == ("beta drug", "contains") and got["zz"] == (None, "unresolved")
