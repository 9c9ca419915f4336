from pyspark.sql import functions as F

from combirisk.functions import codes, names, rules, severity, text
from combirisk.schemas import CONTRAINDICATED, MAJOR, WEIGHT_SCALE


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_code_lists(spark):
    assert one(spark, codes.parse_code_list("v"), "['B01AA03', 'C02']") == ["B01AA03", "C02"]
    assert one(spark, codes.parse_code_list("v"), "[]") == []
    assert one(spark, codes.parse_code_list("v"), None) == []
    assert one(spark, codes.split_codes("v"), "A01| B02 ") == ["A01", "B02"]
    assert one(spark, codes.primary_class(codes.parse_code_list("v")), "['N01AA01', 'B01AA03']") == "Vitamin K antagonists"


def test_split_list(spark):
    assert one(spark, names.split_list("v"), "a + b; c | d and e\nf, A") == ["a", "b", "c", "d", "e", "f"]


def test_normal_name(spark):
    assert one(spark, names.normal_name("v"), "Coumadin") == "warfarin"
    assert one(spark, names.normal_name("v"), "Metformin (oral)  Hydrochloride") == "metformin"


def test_keyword_score_counts_presence_once(spark):
    assert one(spark, text.keyword_score("v"), "bleeding and bleeding risk") == 1.36
    assert one(spark, text.keyword_score("v"), None) == 0.0


def test_rule_severity_bands(spark):
    r = one(spark, text.rule_severity("v"), "risk or severity of qt prolongation and bleeding")
    assert r["severity"] == CONTRAINDICATED and r["method"] == "empirical"
    assert one(spark, text.rule_severity("v"), "never use")["keyword"] == "never use"
    assert one(spark, text.rule_severity("v"), "")["method"] == "default"


def test_mechanism_prefers_kinetic_groups(spark):
    assert one(spark, text.mechanism("v"), "may increase the serum level and bleeding") == "pk_concentration_increase"
    assert one(spark, text.mechanism("v"), "bleeding") == "pd_bleeding_risk"


def test_evidence_rules(spark):
    assert one(spark, text.evidence_class("v"), "amiodarone with sotalol")["evidence"] == "FDA - Combined QT prolongation"
    hit = one(spark, text.evidence_class("v"), "hyperkalemia and seizure")
    assert hit["severity"] == "Major" and hit["confidence"] == 0.81
    assert one(spark, text.evidence_class("v"), "aucx")["confidence"] == 0.5


def test_unknown_labels_take_the_default(spark):
    assert one(spark, severity.scale_value("v", WEIGHT_SCALE), "odd") == 4.0
    assert one(spark, severity.scale_value("v", WEIGHT_SCALE), None) == 4.0


def test_known_pairs_either_way(spark):
    df = spark.createDataFrame([("Aspirin 100", "warfarin x")], "a string, b string")
    assert df.select(severity.known_pair_label(F.col("a"), F.col("b"))).first()[0] == MAJOR


def test_jaccard_empty_is_zero(spark):
    df = spark.createDataFrame([([], ["x"]), (["x", "y"], ["y", "z"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(names.jaccard("a", "b")).collect()] == [0.0, 0.333333]


def test_evidence_patterns_are_tried_once(spark):
    shown = str(text.evidence_class("d"))
    for patterns in rules.EVIDENCE_PATTERNS.values():
        reference = next(iter(patterns.values()))
        assert shown.count(reference) == sum(list(p.values()).count(reference) for p in rules.EVIDENCE_PATTERNS.values())


def test_a_text_is_lowered_once_for_all_rules(spark):
    """Before, every keyword lowered the text again."""
    names = spark.createDataFrame([("Warfarin", "Aspirin")], "v string, w string")
    rules_ = [text.keyword_score("v"), text.text_marker_score("v"), text.staged_class("v"), text.baseline_class("v"), severity.known_pair_label(F.col("v"), F.col("w"))]
    for rule in rules_:
        plan = names.select(rule.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") <= 2
