import duckdb
import pandas as pd
from helpers import awkward_docs, empty_docs, rows

from combirisk.llm import mixing


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 1000, "b": 10, "c": 100, None: 5}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(mixing.source_weights(frame)).collect()}
    # Weights 1, 2, 3, 1 in code point order, null last: b, c and null are capped, a takes the rest.
    assert got == {"b": 30.0, "c": 300.0, None: 15.0, "a": 770.0}


def test_schedule_is_inverted(spark):
    frame = spark.range(0, 101).selectExpr("id / 100 as share")
    for slope in (-0.9, -0.5, 0.0, 0.5, 0.9):
        from pyspark.sql import functions as F

        for share, t in rows(frame.select("share", mixing._time_at(F.col("share"), F.lit(slope)))):
            assert abs((1 - slope) * t + slope * t * t - share) < 1e-12


def test_hot_source_in_many_buckets_agrees_with_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    data = [(i, " ".join("w" for _ in range(i % 23)), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sorted((r[0], r[1], r[2]) for r in rows(mixing.mix(docs).selectExpr("doc_id", "size * copies", "target")))
    con = duckdb.connect()
    con.register("docs", pd.DataFrame(data, columns=["doc_id", "text", "source"]))
    want = sorted(con.execute("with " + mixing.MIX_SQL + " select doc_id, (size * copies)::bigint, target from plan").fetchall())
    assert got == want


def test_training_order_is_sorted_and_complete(spark):
    docs = awkward_docs(spark, extra=True)
    plan = rows(mixing.mix(docs).selectExpr("doc_id", "copies"))
    ordered = mixing.training_order(docs.withColumn("copy", mixing.F.lit("x")))
    got = ordered.collect()
    assert len(got) == sum(c for _, c in plan)
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert ordered.columns == [*docs.columns, "copy", "position"]
    assert len(plan) == 10
    assert rows(mixing.mix(empty_docs(spark))) == [] and rows(mixing.training_order(empty_docs(spark))) == []
