import pytest
from pyspark.sql import functions as F

from combirisk.operators import evaluation as E
from combirisk.operators import ranking as W
from combirisk.operators import statistics as S


def test_perfect_prediction(spark):
    rows = spark.createDataFrame([(i % 4, i % 4) for i in range(20)], "truth int, predicted int")
    m = E.classification_metrics(E.confusion(rows)).first()
    assert m["exact"] == 1 and m["kappa"] == 1 and m["weighted_kappa"] == 1 and m["mae"] == 0


def test_absent_class_is_left_out_of_the_macro_mean(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "truth int, predicted int")
    m = E.classification_metrics(E.confusion(rows)).first()
    assert m["f1_macro"] == pytest.approx((2 / 3 + 0.8) / 2) and m["over"] == 0.25


def test_confidence_one_is_outside_the_bins(spark):
    rows = spark.createDataFrame([(1.0, False), (0.25, True)], "c double, k boolean")
    assert E.calibration(rows, "c", "k").first()["ece"] == 0.375
    assert E.calibration(rows, "c", "k", close_top=True).first()["ece"] == pytest.approx(0.875)


def test_ranking_metrics(spark):
    rankings = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query string, rank int, item string")
    gold = spark.createDataFrame([("q", "y"), ("q", "z")], "query string, item string")
    r = E.ranking_metrics(rankings, gold, 5).first()
    assert r["precision"] == 0.2 and r["recall"] == 0.5 and r["reciprocal_rank"] == 0.5


def test_rouge(spark):
    cases = spark.createDataFrame([(1, "a b c d", "a c d e"), (2, "", "x")], "case_id int, generated string, reference string")
    l = {r["case_id"]: r["rouge_l"] for r in E.rouge_l(cases).collect()}
    one = {r["case_id"]: r["rouge_1"] for r in E.rouge_n(cases, 1).collect()}
    assert l == {1: 0.75, 2: 0.0} and one == {1: 0.75, 2: 0.0}


def test_average_ranks_and_running_totals(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 5, 2, 5, 1]], "v int")
    got = sorted(r["r"] for r in S.average_ranks(df, "v", "r").collect())
    assert got == [1.5, 1.5, 3.0, 5.0, 5.0, 5.0]


def test_mann_whitney(spark):
    df = spark.createDataFrame([(v, g) for g, vs in (("x", [4, 5, 6]), ("y", [1, 2, 3])) for v in vs], "v int, g string")
    assert S.mann_whitney(df, "v", "g", "x", "y").first()["u"] == 9.0


def test_split_is_stratified(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("string").alias("s"))
    got = {(r["s"], r["is_test"]): r["n"] for r in W.stratified_split(df, "id", "s", 0.3).groupBy("s", "is_test").agg(F.count("*").alias("n")).collect()}
    assert got[("true", True)] == 30 and got[("false", True)] == 270


def test_roc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert S.roc(df, "s", "y").first()["auc"] == 0.75


def test_scores_of_one_id_add_up(spark):
    rows = spark.createDataFrame([("x", "bleeding", 0.4, "Major"), ("x", "bleeding", 0.4, "Minor"), ("y", "bleeding", 0.9, "Major"), ("z", None, 0.9, None)], "rid string, description string, confidence double, label string")
    weights = spark.createDataFrame([("bleeding", 0.5)], "term string, weight double")
    got = {r["rid"]: r["score"] for r in E.with_learned_score(rows, weights, ["bleeding"], penalty=True, id_col="rid").collect()}
    assert got == {"x": 0.8, "y": 0.5, "z": 0.0}
    assert E.with_learned_score(rows, weights, ["bleeding"]).count() == 4


def test_rank_test_of_equal_values_divides_as_numbers_do(spark):
    """No spread: z is -0.5 / 0, which raised an error."""
    rows = spark.createDataFrame([(5, k < 3) for k in range(8)], "x int, g boolean")
    row = S.mann_whitney(rows, "x", "g", True, False).first()
    assert (row["n1"], row["n2"], row["u"]) == (3, 5, 7.5)
    assert row["z"] == float("-inf") and row["p_greater"] == row["p_two_sided"] == 1.0
    one = S.mann_whitney(rows.limit(1), "x", "g", True, False).first()
    assert one["n1"] + one["n2"] == 1 and one["z"] != one["z"]
