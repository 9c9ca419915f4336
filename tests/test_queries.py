"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import differ, load_views

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "s3_edge_scan", "s5_catalogue_children", "p19_rule_severity", "p27_split_list", "j3_name_resolution", "j12_fuzzy_expert_pairs", "j13_shared_attributes",
    "a2_crosstab", "a19_risk_zones", "w7_quantile_bins", "g16_robustness", "h2_five_part_risk", "i1_same_class_alternatives", "i9_alternative_score", "e5_percentile_classifier", "e17_faithfulness",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    load_views(con, FOLDER)
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert differ(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_registry_is_complete():
    ids = {n.split("_")[0] for n in entry.queries()}
    want = {f"s{i}" for i in range(1, 14)} | {f"p{i}" for i in range(1, 34)} | {f"j{i}" for i in range(1, 21)} | {f"a{i}" for i in range(1, 26)}
    want |= {f"w{i}" for i in range(1, 12)} | {f"g{i}" for i in range(1, 23)} | {f"h{i}" for i in range(1, 14)} | {"h2a", "h2b", "h2c", "h2d"}
    want |= {f"i{i}" for i in range(1, 14)} | {f"e{i}" for i in range(1, 20)}
    assert want <= ids
    assert set(entry.oracle_sql()) <= set(entry.queries())
