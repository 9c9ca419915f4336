import duckdb
from combirisk.operators.pairs import max_severity_edges
from combirisk.plans import views as V
from combirisk.plans.check_views import with_views

SF = "/root/testdata/sf0.001"


def test_edges_are_those_of_the_interaction_rows(spark):
    """Pairs packed as numbers keep the rows of the general operator, ties and rows without a label included."""
    got, want = V.edges(spark, SF), max_severity_edges(V.interactions(spark, SF))
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_pairs_travel_without_names_and_texts(spark):
    pairs = V.line_pairs(spark, SF)
    assert not [f.name for f in pairs.schema.fields if f.dataType.typeName() == "string"]
    plan = V.interactions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_interactions_follow_their_sql(spark):
    con = duckdb.connect()
    for name in ("part", "lineitem", "orders", "customer"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    keys = ["drug_name_1", "drug_name_2", "interaction_description", "severity_numeric", "severity_confidence"]
    want = con.execute(with_views(f"SELECT {', '.join(keys)} FROM interactions")).fetchall()
    got = [tuple(r) for r in V.interactions(spark, SF).select(*keys).collect()]
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(order, got)) == sorted(map(order, want))


def test_pairs_are_read_by_all_cores(spark):
    """Before, the small table of numbers was one file, and one task made all texts."""
    assert V.interactions(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
