from pyspark.sql import functions as F

from combirisk.operators import resolve as R


def test_update_of_a_group_of_edges(spark):
    """One update speaks for all edges of its item and year; the last one wins, and edges without one stay."""
    edges = spark.createDataFrame(
        [("x", "a 1993", "unknown", "1993"), ("x", "b 1993", "unknown", "1993"), ("x", "a 1994", "unknown", "1994"), ("y", "a 1993", "unknown", "1993")],
        "item string, attr string, frequency string, yr string",
    )
    updates = spark.createDataFrame([("x", "1993", 1, "rare"), ("x", "1993", 2, "common"), ("y", "1995", 9, "rare")], "item string, yr string, ordinal int, frequency string")
    got = R.update_frequencies(edges, updates, ("item", "yr")).select("item", "attr", "frequency").collect()
    assert sorted(map(tuple, got)) == [("x", "a 1993", "common"), ("x", "a 1994", "unknown"), ("x", "b 1993", "common"), ("y", "a 1993", "unknown")]
    single = R.update_frequencies(edges, updates.select("item", F.concat_ws(" ", F.lit("a"), "yr").alias("attr"), "ordinal", "frequency"))
    assert {tuple(r) for r in single.filter("frequency <> 'unknown'").select("item", "attr", "frequency").collect()} == {("x", "a 1993", "common")}
