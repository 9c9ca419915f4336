"""Registered queries of the scalar functions (P rows of the inventory)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from combirisk.functions import codes, names, rules, severity, text
from combirisk.operators.attributes import pair_similarity
from combirisk.plans import views as V
from combirisk.plans.check_views import any_contains, lit, phenotype_list, sql_list
from combirisk.plans.registry import query
from combirisk.schemas import NUMERIC_SCALE, ORDINAL_SCALE, SHARE_SCALE, WEIGHT_SCALE

D = "lower(coalesce(interaction_description, ''))"
LABEL_SQL = """CASE {n} WHEN 4 THEN 'Contraindicated interaction' WHEN 3 THEN 'Major interaction'
 WHEN 2 THEN 'Moderate interaction' ELSE 'Minor interaction' END"""


def first_group(groups, column=D, prefix="", test=any_contains) -> str:
    return " ".join(f"WHEN {test(column, kws)} THEN {lit(prefix + str(name))}" for name, kws in groups.items())


def first_keyword(keywords, column=D) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, {lit(k)}) THEN {lit(k)}" for k in keywords) + " END"


def any_regex(column, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {lit(p)})" for p in patterns) + ")"


def word_test(column, phrase) -> str:
    return f"regexp_matches({column}, {lit(chr(92) + 'b' + re.escape(phrase) + chr(92) + 'b')})"


def keyword_sum(weights) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({D}, {lit(k)}) THEN {round(w * 100)} ELSE 0 END" for k, w in weights.items()) + ")"


@query("p1_normal_names", "SELECT lower(trim(p_name)) || '|' || lower(trim(p_brand)) AS name, count(*) AS n FROM part GROUP BY 1", views=False)
def p1(spark, sf):
    part = V.table(spark, sf, "part")
    name = F.concat_ws("|", names.clean_name("p_name"), names.clean_name("p_brand"))
    return part.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p2_parse_code_list",
    "SELECT item, atc, array_to_string(codes, '|') AS codes, len(codes) AS n_codes, array_to_string(codes, '|') AS resplit FROM items",
)
def p2(spark, sf):
    items = V.items(spark, sf)
    joined = F.array_join("codes", "|")
    return items.select(
        "item", "atc", joined.alias("codes"), F.size("codes").alias("n_codes"),
        F.array_join(codes.split_codes(joined), "|").alias("resplit"),
    )


@query(
    "p3_code_prefixes",
    """SELECT prefix, plen, count(DISTINCT item) AS n_items FROM (
      SELECT item, c[1:l] AS prefix, l AS plen FROM (SELECT item, unnest(codes) AS c FROM items), (SELECT unnest([1, 3, 4, 5]) AS l)
      UNION ALL SELECT item, c, 7 FROM (SELECT item, unnest(codes) AS c FROM items)) GROUP BY 1, 2""",
)
def p3(spark, sf):
    index = codes.prefix_index(V.items(spark, sf), "item", "codes")
    return index.groupBy("prefix", "plen").agg(F.count("item").alias("n_items"))


@query(
    "p4_code_labels",
    f"""SELECT code, {{l1}} AS level1, {{l2}} AS level2, {{l4}} AS level4 FROM (SELECT DISTINCT unnest(codes) AS code FROM items)""".format(
        l1="CASE code[1:1] " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CODE_LEVEL1.items()) + " ELSE 'Unknown' END",
        l2="CASE code[1:3] " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CODE_LEVEL2.items()) + " ELSE code[1:3] END",
        l4="CASE code[1:5] " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CODE_LEVEL4.items()) + " ELSE code[1:5] END",
    ),
)
def p4(spark, sf):
    code = F.col("code")
    return (
        V.items(spark, sf).select(F.explode("codes").alias("code")).distinct()
        .select("code", codes.level1_label(code).alias("level1"), codes.level2_label(code).alias("level2"), codes.level4_label(code).alias("level4"))
    )


@query("p5_class_flags", "SELECT item, len(list_filter(codes, lambda x: x LIKE 'C%')) > 0 AS is_cardiovascular, len(list_filter(codes, lambda x: x LIKE 'B01%')) > 0 AS is_antithrombotic FROM items")
def p5(spark, sf):
    return V.items(spark, sf).select(
        "item", codes.starts_any("codes", "C").alias("is_cardiovascular"), codes.starts_any("codes", "B01").alias("is_antithrombotic")
    )


L2_SQL = "CASE c[1:3] " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CODE_LEVEL2.items()) + " ELSE c[1:3] END"
L4_SQL = "CASE c[1:5] " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.CODE_LEVEL4.items()) + " ELSE c[1:5] END"
CLASS_SQL = f"SELECT item, CASE WHEN c LIKE 'C%' THEN {L2_SQL} WHEN c LIKE 'B01%' THEN {L4_SQL} ELSE 'Other' END AS drug_class FROM (SELECT item, list_filter(codes, lambda x: x LIKE 'C%' OR x LIKE 'B01%')[1] AS c FROM items)"


@query("p6_primary_class", CLASS_SQL)
def p6(spark, sf):
    return V.items(spark, sf).select("item", codes.primary_class("codes").alias("drug_class"))


@query(
    "p7_merged_flag",
    """SELECT item, bool_or(cv OR thr) AS is_cardiovascular, bool_or(thr) AS is_antithrombotic FROM (
      SELECT drug_name_1 AS item, is_cardiovascular_1 AS cv, is_antithrombotic_1 AS thr FROM interactions
      UNION ALL SELECT drug_name_2, is_cardiovascular_2, is_antithrombotic_2 FROM interactions) GROUP BY 1""",
)
def p7(spark, sf):
    rows = V.interactions(spark, sf)
    sides = rows.select(
        F.explode(
            F.array(
                F.struct(F.col("drug_name_1").alias("item"), F.col("is_cardiovascular_1").alias("cv"), F.col("is_antithrombotic_1").alias("at")),
                F.struct(F.col("drug_name_2").alias("item"), F.col("is_cardiovascular_2").alias("cv"), F.col("is_antithrombotic_2").alias("at")),
            )
        ).alias("s")
    ).select("s.*")
    return sides.groupBy("item").agg(
        F.bool_or(codes.merged_flag(F.col("cv"), F.col("at"))).alias("is_cardiovascular"), F.bool_or("at").alias("is_antithrombotic")
    )


@query(
    "p8_cohort_filter",
    """SELECT drugbank_id_1, drugbank_id_2, severity_label, count(*) AS n FROM interactions
    WHERE is_cardiovascular_1 OR is_antithrombotic_1 OR is_cardiovascular_2 OR is_antithrombotic_2 GROUP BY ALL""",
)
def p8(spark, sf):
    rows = V.interactions(spark, sf)
    flag = F.col("is_cardiovascular_1") | F.col("is_antithrombotic_1") | F.col("is_cardiovascular_2") | F.col("is_antithrombotic_2")
    return rows.filter(flag).groupBy("drugbank_id_1", "drugbank_id_2", "severity_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_blank_descriptions",
    """SELECT drug_name_1, drug_name_2, trim(coalesce(interaction_description, '')) = '' AS is_blank,
      CASE WHEN trim(coalesce(interaction_description, '')) <> '' THEN severity_label END AS label, count(*) AS n
    FROM interactions GROUP BY ALL""",
)
def p9(spark, sf):
    blank = F.trim(F.coalesce("interaction_description", F.lit(""))) == ""
    return (
        V.interactions(spark, sf)
        .select("drug_name_1", "drug_name_2", blank.alias("is_blank"), F.when(~blank, F.col("severity_label")).alias("label"))
        .groupBy("drug_name_1", "drug_name_2", "is_blank", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p10_severity_scales",
    """SELECT severity_label, count(*) AS n,
      CASE severity_label WHEN 'Contraindicated interaction' THEN 10.0::DOUBLE WHEN 'Major interaction' THEN 7.0 WHEN 'Moderate interaction' THEN 4.0 WHEN 'Minor interaction' THEN 1.0 ELSE 4.0 END AS weight,
      CASE severity_label WHEN 'Contraindicated interaction' THEN 4 WHEN 'Major interaction' THEN 3 WHEN 'Moderate interaction' THEN 2 WHEN 'Minor interaction' THEN 1 ELSE 2 END AS numeric,
      CASE split_part(severity_label, ' ', 1) WHEN 'Contraindicated' THEN 3 WHEN 'Major' THEN 2 WHEN 'Moderate' THEN 1 WHEN 'Minor' THEN 0 ELSE 1 END AS ordinal,
      CASE WHEN severity_label LIKE 'Contra%' THEN 1.0::DOUBLE WHEN severity_label LIKE 'Major%' THEN 0.7 WHEN severity_label LIKE 'Moderate%' THEN 0.4 WHEN severity_label LIKE 'Minor%' THEN 0.15 ELSE 0.2 END AS share
    FROM interactions GROUP BY ALL""",
)
def p10(spark, sf):
    c = F.col("severity_label")
    return (
        V.interactions(spark, sf).groupBy("severity_label").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "severity_label", "n",
            severity.scale_value(c, WEIGHT_SCALE).alias("weight"),
            severity.scale_value(c, NUMERIC_SCALE).alias("numeric"),
            severity.scale_value(F.split_part(c, F.lit(" "), F.lit(1)), ORDINAL_SCALE).alias("ordinal"),
            severity.scale_by_substring(c, SHARE_SCALE).alias("share"),
        )
    )


@query(
    "p11_three_levels",
    """SELECT CASE WHEN severity_label IN ('Contraindicated interaction', 'Major interaction') THEN 'Major' ELSE split_part(severity_label, ' ', 1) END AS level, count(*) AS n
    FROM interactions GROUP BY 1""",
)
def p11(spark, sf):
    return V.interactions(spark, sf).groupBy(severity.three_level("severity_label").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p12_severity_preference",
    """SELECT CASE WHEN severity_confidence >= 0.5 THEN severity_label ELSE 'Moderate interaction' END AS severity, count(*) AS n FROM interactions GROUP BY 1""",
)
def p12(spark, sf):
    rows = V.interactions(spark, sf)
    recal = rows.withColumn(
        "severity_recalibrated", F.when(F.col("severity_confidence") >= 0.5, F.col("severity_label")).otherwise("Moderate interaction")
    )
    return recal.groupBy(severity.severity_col(recal).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_phenotype_tags",
    f"""SELECT drug_name_1, drug_name_2, array_to_string({phenotype_list("coalesce(interaction_description, '')")}, '|') AS phenotypes, count(*) AS n FROM interactions GROUP BY ALL""",
)
def p13(spark, sf):
    return (
        V.interactions(spark, sf)
        .select("drug_name_1", "drug_name_2", F.array_join(text.phenotype_tags("interaction_description"), "|").alias("phenotypes"))
        .groupBy("drug_name_1", "drug_name_2", "phenotypes").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p14_mechanism",
    f"""SELECT drug_name_1, drug_name_2, CASE {first_group(rules.PK_MECHANISMS, prefix='pk_', test=any_regex)} {first_group(rules.PD_MECHANISMS, prefix='pd_', test=any_regex)} ELSE 'unknown' END AS mechanism, count(*) AS n FROM interactions GROUP BY ALL""",
)
def p14(spark, sf):
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", text.mechanism("interaction_description").alias("mechanism"))
        .groupBy("drug_name_1", "drug_name_2", "mechanism").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p15_clinical_effect",
    f"""SELECT drug_name_1, drug_name_2, CASE WHEN coalesce(interaction_description, '') = '' THEN 'unknown' {first_group(rules.CLINICAL_EFFECTS)} ELSE 'general' END AS effect, count(*) AS n FROM interactions GROUP BY ALL""",
)
def p15(spark, sf):
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", text.clinical_effect("interaction_description").alias("effect"))
        .groupBy("drug_name_1", "drug_name_2", "effect").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p16_interaction_type",
    f"""SELECT drug_name_1, drug_name_2, CASE {first_group(rules.INTERACTION_TYPES)} ELSE 'Other' END AS kind,
      CASE {" ".join(f"WHEN {any_contains(D, kws)} THEN {i}" for i, kws in enumerate(rules.INTERACTION_TYPE_CODES))} ELSE {len(rules.INTERACTION_TYPE_CODES)} END AS code,
      count(*) AS n FROM interactions GROUP BY ALL""",
)
def p16(spark, sf):
    return (
        V.interactions(spark, sf)
        .select("drug_name_1", "drug_name_2", text.interaction_type("interaction_description").alias("kind"), text.interaction_type_code("interaction_description").alias("code"))
        .groupBy("drug_name_1", "drug_name_2", "kind", "code").agg(F.count(F.lit(1)).alias("n"))
    )


PAIR_CATEGORY_SQL = """CASE WHEN is_cardiovascular_1 AND is_cardiovascular_2 THEN 'Both Cardiovascular'
  WHEN is_antithrombotic_1 AND is_antithrombotic_2 THEN 'Both Antithrombotic'
  WHEN (is_cardiovascular_1 AND is_antithrombotic_2) OR (is_antithrombotic_1 AND is_cardiovascular_2) THEN 'Cardiovascular + Antithrombotic'
  WHEN is_cardiovascular_1 OR is_cardiovascular_2 THEN 'Cardiovascular + Other'
  WHEN is_antithrombotic_1 OR is_antithrombotic_2 THEN 'Antithrombotic + Other' ELSE 'Other' END"""


@query("p17_pair_category", f"SELECT drug_name_1, drug_name_2, {PAIR_CATEGORY_SQL} AS category, count(*) AS n FROM interactions GROUP BY ALL")
def p17(spark, sf):
    flags = [F.col(c) for c in ("is_cardiovascular_1", "is_antithrombotic_1", "is_cardiovascular_2", "is_antithrombotic_2")]
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", codes.pair_category(*flags).alias("category"))
        .groupBy("drug_name_1", "drug_name_2", "category").agg(F.count(F.lit(1)).alias("n"))
    )


@query("p18_keyword_score", f"SELECT drug_name_1, drug_name_2, {keyword_sum(rules.KEYWORD_WEIGHTS)} / 100.0::DOUBLE AS score, count(*) AS n FROM interactions GROUP BY ALL")
def p18(spark, sf):
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", text.keyword_score("interaction_description").alias("score"))
        .groupBy("drug_name_1", "drug_name_2", "score").agg(F.count(F.lit(1)).alias("n"))
    )


def rule_severity_sql(source="interactions"):
    s = f"({keyword_sum(rules.KEYWORD_WEIGHTS)} / 100.0::DOUBLE)"
    fb = rules.FALLBACK_KEYWORDS
    labels = {"contraindicated": "Contraindicated interaction", "major": "Major interaction", "moderate": "Moderate interaction", "minor": "Minor interaction"}
    sev = " ".join(f"WHEN {any_contains(D, k)} THEN {lit(labels[n])}" for n, k in fb.items())
    conf = " ".join(f"WHEN {any_contains(D, k)} THEN {rules.FALLBACK_CONFIDENCE[n]}::DOUBLE" for n, k in fb.items())
    meth = " ".join(f"WHEN {any_contains(D, k)} THEN {lit('rule_based' if n == 'minor' else 'keyword_fallback')}" for n, k in fb.items())
    kws = [k for ks in fb.values() for k in ks]
    band = "score >= 1.8 OR score <= -1.5 OR score > 0"
    return f"""SELECT * EXCLUDE (score),
      CASE WHEN score >= 2.5 THEN 'Contraindicated interaction' WHEN score >= 1.8 THEN 'Major interaction' WHEN score <= -1.5 THEN 'Minor interaction' WHEN score > 0 THEN 'Moderate interaction' {sev} ELSE 'Moderate interaction' END AS severity,
      CASE WHEN score >= 2.5 THEN least(0.90::DOUBLE, round(0.70 + score * 0.05, 6)) WHEN score >= 1.8 THEN least(0.85::DOUBLE, round(0.65 + score * 0.05, 6)) WHEN score <= -1.5 THEN 0.70 WHEN score > 0 THEN 0.75 {conf} ELSE 0.50 END AS confidence,
      CASE WHEN {band} THEN 'empirical' {meth} ELSE 'default' END AS method,
      CASE WHEN {band} THEN score END AS score,
      CASE WHEN NOT ({band}) THEN {first_keyword(kws)} END AS keyword
    FROM (SELECT *, {s} AS score FROM {source})"""


@query("p19_rule_severity", f"SELECT drug_name_1, drug_name_2, severity, confidence, method, score, keyword, count(*) AS n FROM ({rule_severity_sql()}) GROUP BY ALL")
def p19(spark, sf):
    return (
        V.interactions(spark, sf).withColumn("score_", text.keyword_score("interaction_description"))
        .select("drug_name_1", "drug_name_2", text.rule_severity("interaction_description", "score_").alias("r"))
        .select("drug_name_1", "drug_name_2", "r.*").groupBy("drug_name_1", "drug_name_2", "severity", "confidence", "method", "score", "keyword")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def marker_sql():
    by_length = lambda ws: sorted(ws, key=len, reverse=True)
    groups = [(4.0, "contra_effect", rules.CONTRA_EFFECTS), (3.2, "major_effect", by_length(rules.MAJOR_EFFECTS)), (4.0, "strong_contra", rules.CONTRA_STRONG),
              (3.0, "strong_major", rules.MAJOR_STRONG), (2.0, "moderate_effect", by_length(rules.MODERATE_EFFECTS)), (1.5, "minor_effect", rules.MINOR_EFFECTS)]
    null = "WHEN interaction_description IS NULL THEN"
    score = f"CASE {null} 2.0::DOUBLE " + " ".join(f"WHEN {any_contains(D, g)} THEN {s}" for s, _, g in groups) + " ELSE 1.6 END"
    evidence = f"CASE {null} 'none' " + " ".join(f"WHEN {any_contains(D, g)} THEN {lit(e)}" for _, e, g in groups) + " ELSE 'default' END"
    marker = f"CASE {null} NULL " + " ".join(f"WHEN {any_contains(D, g)} THEN {first_keyword(g)}" for _, _, g in groups) + " END"
    return score, evidence, marker


MARKER_SCORE, MARKER_EVIDENCE, MARKER_WORD = marker_sql()


@query("p20_text_markers", f"SELECT drug_name_1, drug_name_2, {MARKER_SCORE} AS score, {MARKER_EVIDENCE} AS evidence, {MARKER_WORD} AS marker, count(*) AS n FROM interactions GROUP BY ALL")
def p20(spark, sf):
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", text.text_marker_score("interaction_description").alias("m"))
        .select("drug_name_1", "drug_name_2", "m.*").groupBy("drug_name_1", "drug_name_2", "score", "evidence", "marker").agg(F.count(F.lit(1)).alias("n"))
    )


def listed_sql(pairs, a="drug_name_1", b="drug_name_2"):
    return "(" + " OR ".join(f"(contains({a}, {lit(p)}) AND contains({b}, {lit(q)})) OR (contains({b}, {lit(p)}) AND contains({a}, {lit(q)}))" for p, q in pairs) + ")"


KNOWN_SQL = f"CASE WHEN {listed_sql(rules.KNOWN_CONTRAINDICATED)} THEN 'Contraindicated interaction' WHEN {listed_sql(rules.KNOWN_MAJOR)} THEN 'Major interaction' END"


@query("p21_known_pairs", f"SELECT drug_name_1, drug_name_2, {KNOWN_SQL} AS known, count(*) AS n FROM interactions GROUP BY ALL")
def p21(spark, sf):
    return (
        V.interactions(spark, sf)
        .select("drug_name_1", "drug_name_2", severity.known_pair_label(F.col("drug_name_1"), F.col("drug_name_2")).alias("known"))
        .groupBy("drug_name_1", "drug_name_2", "known").agg(F.count(F.lit(1)).alias("n"))
    )


def classes_sql(table, column):
    return "list_filter([" + ", ".join(f"CASE WHEN {any_contains(column, m)} THEN {lit(k)} END" for k, m in table.items()) + "], lambda x: x IS NOT NULL)"


RISK_CLASS_SQL = """CASE WHEN list_contains(c1, 'maois') AND list_contains(c2, 'maois') THEN 'very_high'
  WHEN (list_contains(c1, 'anticoagulants') AND list_contains(c2, 'anticoagulants')) OR (list_contains(c1, 'qt_prolonging') AND list_contains(c2, 'qt_prolonging')) THEN 'high'
  WHEN len(c1) > 0 AND len(c2) > 0 THEN 'elevated' WHEN len(c1) > 0 OR len(c2) > 0 THEN 'moderate' ELSE 'standard' END"""


@query(
    "p22_pair_risk_class",
    f"""SELECT drug_name_1, drug_name_2, {RISK_CLASS_SQL} AS risk_class,
      CASE WHEN (list_contains(s1, 'maois') AND list_contains(s2, 'serotonergics')) OR (list_contains(s2, 'maois') AND list_contains(s1, 'serotonergics')) OR (list_contains(s1, 'maois') AND list_contains(s2, 'maois')) THEN 4.0::DOUBLE
        WHEN (list_contains(s1, 'anticoagulants') AND list_contains(s2, 'anticoagulants')) OR (list_contains(s1, 'qt_prolonging') AND list_contains(s2, 'qt_prolonging')) THEN 3.5
        WHEN len(s1) > 0 AND len(s2) > 0 THEN 3.0 WHEN len(s1) > 0 OR len(s2) > 0 THEN 2.5 ELSE 2.0 END AS class_score
    FROM (SELECT drug_name_1, drug_name_2, {classes_sql(rules.RISK_CLASSES, 'drug_name_1')} AS c1, {classes_sql(rules.RISK_CLASSES, 'drug_name_2')} AS c2,
      {classes_sql(rules.SCORED_CLASSES, 'drug_name_1')} AS s1, {classes_sql(rules.SCORED_CLASSES, 'drug_name_2')} AS s2 FROM (SELECT DISTINCT drug_name_1, drug_name_2 FROM interactions))""",
)
def p22(spark, sf):
    one, two = F.col("drug_name_1"), F.col("drug_name_2")
    return (
        V.interactions(spark, sf).select(one, two).distinct()
        .select(one, two, severity.pair_risk_class(one, two).alias("risk_class"), severity.pair_class_score(one, two).alias("class_score"))
    )


NUM_SQL = "coalesce(severity_numeric, 2)"
ADJUST_SQL = f"CASE WHEN {NUM_SQL} = 4 AND severity_confidence < 0.65 THEN 3.0::DOUBLE WHEN {NUM_SQL} >= 3 AND severity_confidence < 0.45 THEN 2.5 ELSE {NUM_SQL} END"


@query("p23_confidence_adjusted", f"SELECT drug_name_1, drug_name_2, severity_confidence, {ADJUST_SQL} AS adjusted, count(*) AS n FROM interactions GROUP BY ALL")
def p23(spark, sf):
    adjusted = severity.confidence_adjusted(F.col("severity_label"), F.col("severity_confidence"))
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", "severity_confidence", adjusted.alias("adjusted"))
        .groupBy("drug_name_1", "drug_name_2", "severity_confidence", "adjusted").agg(F.count(F.lit(1)).alias("n"))
    )


HYBRID_SQL = f"""SELECT *,
   coalesce(known, CASE WHEN fs >= 3.2 THEN 'Contraindicated interaction' WHEN fs >= 2.5 THEN 'Major interaction' WHEN fs >= 2.0 THEN 'Moderate interaction' ELSE 'Minor interaction' END) AS recal,
   CASE WHEN known IS NOT NULL THEN 'known_pair' ELSE 'hybrid' END AS method,
   CASE WHEN known IS NOT NULL THEN 0.95::DOUBLE ELSE least(0.95::DOUBLE, severity_confidence + 0.1) END AS recal_confidence
 FROM (SELECT *, round(0.2::DOUBLE * ({ADJUST_SQL}) + 0.5::DOUBLE * ({MARKER_SCORE}) + 0.3::DOUBLE * (CASE {RISK_CLASS_SQL} WHEN 'very_high' THEN 4.0 WHEN 'high' THEN 3.5 WHEN 'elevated' THEN 3.0 WHEN 'moderate' THEN 2.5 ELSE 2.0 END), 6) AS fs,
        {KNOWN_SQL} AS known
   FROM (SELECT *, {classes_sql(rules.RISK_CLASSES, 'drug_name_1')} AS c1, {classes_sql(rules.RISK_CLASSES, 'drug_name_2')} AS c2 FROM interactions))"""


@query(
    "p24_hybrid_recalibration",
    f"SELECT drug_name_1, drug_name_2, recal AS severity, method, round(recal_confidence, 6) AS confidence, CASE WHEN known IS NULL THEN fs END AS final_score, count(*) AS n FROM ({HYBRID_SQL}) GROUP BY ALL",
)
def p24(spark, sf):
    recal = severity.hybrid_recalibration(V.interactions(spark, sf))
    return recal.groupBy(
        "drug_name_1", "drug_name_2", F.col("severity_recalibrated").alias("severity"), F.col("recal_method").alias("method"),
        F.round("recal_confidence", 6).alias("confidence"), "final_score",
    ).agg(F.count(F.lit(1)).alias("n"))


def evidence_sql(column=D, source="interactions", empty="coalesce(interaction_description, '') = ''"):
    pairs = [(f"contains({column}, {lit(a)}) AND contains({column}, {lit(b)})", s, c) for a, b, s, c in rules.EVIDENCE_PAIRS]
    qt = "(" + " + ".join(f"contains({column}, {lit(n)})::INT" for n in rules.QT_NAMES) + ") >= 2"
    cols = {s: "list_filter([" + ", ".join(f"CASE WHEN {word_test(column, p)} THEN {lit(r)} END" for p, r in ps.items()) + "], lambda x: x IS NOT NULL)" for s, ps in rules.EVIDENCE_PATTERNS.items()}
    names_ = {s: f"m_{s.lower()}" for s in cols}
    sev = f"CASE WHEN {empty} THEN 'Moderate' " + " ".join(f"WHEN {t} THEN {lit(s)}" for t, s, _ in pairs) + f" WHEN {qt} THEN {lit(rules.EVIDENCE_QT[0])} " + " ".join(f"WHEN len({names_[s]}) > 0 THEN {lit(s)}" for s in cols) + " ELSE 'Moderate' END"
    conf = f"CASE WHEN {empty} THEN 0.5::DOUBLE " + " ".join(f"WHEN {t} THEN 0.90" for t, _, _ in pairs) + f" WHEN {qt} THEN {rules.EVIDENCE_QT[1]} " + " ".join(f"WHEN len({names_[s]}) > 0 THEN round(least(0.99::DOUBLE, {rules.EVIDENCE_BASE[s]}::DOUBLE + least(0.1::DOUBLE, len({names_[s]}) * 0.02::DOUBLE)), 6)" for s in cols) + " ELSE 0.5 END"
    ev = f"CASE WHEN {empty} THEN 'Default - No description' " + " ".join(f"WHEN {t} THEN {lit(c)}" for t, _, c in pairs) + f" WHEN {qt} THEN {lit(rules.EVIDENCE_QT[2])} " + " ".join(f"WHEN len({names_[s]}) > 0 THEN {names_[s]}[1]" for s in cols) + " ELSE 'Default - No specific pattern matched' END"
    lists = ", ".join(f"{q} AS {names_[s]}" for s, q in cols.items())
    return f"SELECT *, {sev} AS ev_severity, {conf} AS ev_confidence, {ev} AS ev_evidence FROM (SELECT *, {lists} FROM {source})"


@query(
    "p25_evidence_class",
    f"SELECT drug_name_1, drug_name_2, ev_severity AS severity, ev_confidence AS confidence, ev_evidence AS evidence, count(*) AS n FROM ({evidence_sql()}) GROUP BY ALL",
)
def p25(spark, sf):
    return (
        # A generator computes its record once for each row; three fields of a struct would compute it three times.
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", F.inline(F.array(text.evidence_class("interaction_description"))))
        .groupBy("drug_name_1", "drug_name_2", "severity", "confidence", "evidence").agg(F.count(F.lit(1)).alias("n"))
    )


def staged_sql():
    found = "list_filter([" + ", ".join(f"CASE WHEN contains({D}, {lit(n)}) THEN {lit(n)} END" for n in rules.STAGED_QT_NAMES) + "], lambda x: x IS NOT NULL)"
    tests = [("coalesce(interaction_description, '') = ''", list(rules.STAGED_EMPTY))]
    both = lambda a, b: f"contains({D}, {lit(a)}) AND contains({D}, {lit(b)})"
    tests += [(both(a, b), ["Contraindicated", *r, 0.95, "Contraindicated"]) for a, b, *r in rules.STAGED_CONTRAINDICATED]
    tests += [(both(a, b), ["High", *r, 0.85, "Major"]) for a, b, *r in rules.STAGED_HIGH]
    tests += [("len(qt) >= 2", list(rules.STAGED_QT))]
    tests += [(word_test(D, p), [s, *r[:-1], 0.7 if s == "High" else 0.6, r[-1]]) for p, s, *r in rules.STAGED_PATTERNS]
    cols = []
    for i, name in enumerate(text.STAGED_FIELDS):
        def value(t, row):
            if t == "len(qt) >= 2" and i == 1:
                return lit(row[1] + " from ") + " || array_to_string(qt[1:2], ', ')"
            return f"{row[i]}::DOUBLE" if isinstance(row[i], float) else lit(row[i])
        default = rules.STAGED_DEFAULT[i]
        cols.append("CASE " + " ".join(f"WHEN {t} THEN {value(t, row)}" for t, row in tests) + f" ELSE {default if isinstance(default, float) else lit(default)} END AS {name}")
    return f"SELECT drug_name_1, drug_name_2, {', '.join(cols)} FROM (SELECT *, {found} AS qt FROM interactions)"


@query("p26_staged_class", f"SELECT *, count(*) AS n FROM ({staged_sql()}) GROUP BY ALL")
def p26(spark, sf):
    return (
        V.interactions(spark, sf).select("drug_name_1", "drug_name_2", text.staged_class("interaction_description").alias("s"))
        .select("drug_name_1", "drug_name_2", "s.*").groupBy("drug_name_1", "drug_name_2", *text.STAGED_FIELDS).agg(F.count(F.lit(1)).alias("n"))
    )


RAW_SQL = """SELECT regimen_id, CASE regimen_id % 5 WHEN 0 THEN array_to_string(xs, ' + ') WHEN 1 THEN array_to_string(xs, '; ') WHEN 2 THEN array_to_string(xs, ' | ')
   WHEN 3 THEN array_to_string(xs, ' and ') ELSE array_to_string(xs, ', ') END AS raw
 FROM (SELECT l_orderkey AS regimen_id, list(item ORDER BY l_linenumber, item) AS xs FROM lines GROUP BY 1)"""


def raw_regimens(spark, sf):
    """One typed-in string per regimen, in varying notations, items repeated as in the order."""
    sep = F.element_at(F.array(*[F.lit(s) for s in (" + ", "; ", " | ", " and ", ", ")]), (F.col("regimen_id") % 5 + 1).cast("int"))
    listed = V.lines(spark, sf).groupBy(F.col("l_orderkey").alias("regimen_id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "item"))).alias("listed")
    )
    return listed.select("regimen_id", F.col("listed.item").alias("items"), sep.alias("sep")).select(
        "regimen_id", F.expr("array_join(items, sep)").alias("raw")
    )


@query(
    "p27_split_list",
    f""", raw AS ({RAW_SQL}) SELECT regimen_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(parts), lambda x: {{'p': list_position(parts, x), 'v': x}})), lambda y: y.v), '|') AS items, len(list_distinct(parts)) AS n
    FROM (SELECT regimen_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(raw, '\\s*\\+\\s*', ',', 'g'), '\\s+and\\s+', ',', 'g'), '\\s*[;|]\\s*', ',', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM raw)""",
)
def p27(spark, sf):
    parts = names.split_list("raw")
    return raw_regimens(spark, sf).select("regimen_id", F.array_join(parts, "|").alias("items"), F.size(parts).alias("n"))


@query(
    "p28_narrative_terms",
    """, cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
        '\\d+\\s*(mg|ml|mcg|g|iu|units?)\\b', ' ', 'g'),
        '\\b(once|twice|thrice|\\d+\\s*times?)\\s*(daily|a\\s*day|per\\s*day|weekly)?\\b', ' ', 'g'),
        '\\b(morning|evening|night|afternoon|bedtime|before|after|with)\\s*(meals?|food|breakfast|lunch|dinner)?\\b', ' ', 'g'),
        '\\b(tablet|capsule|pill|dose|dosage)s?\\b', ' ', 'g') AS t FROM (
          SELECT l_orderkey * 10 + l_linenumber AS doc_id, 'Take ' || item || ' ' || qty || ' mg tablets ' || (CASE WHEN mon % 2 = 0 THEN 'twice daily' ELSE 'with meals' END) || ' after ' || rf || ' visit' AS text FROM lines))
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '\\b([a-z]{2,})\\b', 1), lambda w: length(w) >= 3))), '|') AS unigrams,
      array_to_string(list_sort(list_distinct(list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda p: length(p) >= 3))), '|') AS bigrams
    FROM (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM cleaned)""",
)
def p28(spark, sf):
    note = F.concat_ws(
        "", F.lit("Take "), "item", F.lit(" "), F.col("qty").cast("string"), F.lit(" mg tablets "),
        F.when(F.col("mon") % 2 == 0, "twice daily").otherwise("with meals"), F.lit(" after "), "rf", F.lit(" visit"),
    )
    terms = V.lines(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), names.narrative_terms(note).alias("t"))
    return terms.select("doc_id", F.array_join(F.array_sort("t.unigrams"), "|").alias("unigrams"), F.array_join(F.array_sort("t.bigrams"), "|").alias("bigrams"))


ALIAS_ROWS = sorted(rules.ALIASES.items())
ALIAS_SQL = "(VALUES " + ", ".join(f"({i}, {lit(a)}, {lit(g)})" for i, (a, g) in enumerate(ALIAS_ROWS)) + ") al(i, alias, known)"


@query(
    "p29_normal_name",
    f"""SELECT DISTINCT raw, name FROM (SELECT generic AS name, upper(generic) || ' (' || lower(kind) || ') ' || (CASE WHEN brand % 2 = 0 THEN 'hydrochloride' ELSE 'sodium' END) AS raw FROM items
    UNION ALL SELECT known, ' ' || upper(alias) || ' ' FROM items JOIN {ALIAS_SQL} ON i = brand % {len(ALIAS_ROWS)})""",
)
def p29(spark, sf):
    raw = F.concat_ws("", F.upper("generic"), F.lit(" ("), F.lower("kind"), F.lit(") "), F.when(F.col("brand") % 2 == 0, "hydrochloride").otherwise("sodium"))
    brand = F.get(F.array(*[F.lit(a) for a, _ in ALIAS_ROWS]), (F.col("brand") % len(ALIAS_ROWS)).cast("int"))
    rows = V.items(spark, sf).select(F.explode(F.array(raw, F.concat(F.lit(" "), F.upper(brand), F.lit(" ")))).alias("raw"))
    return rows.distinct().select("raw", names.normal_name("raw").alias("name"))


SIM_SQL = """CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 0.4::DOUBLE * len(list_intersect(list_distinct(string_split({a}, '')), list_distinct(string_split({b}, '')))) / len(list_distinct(list_concat(string_split({a}, ''), string_split({b}, ''))))
   + 0.3::DOUBLE * least(length({a}), length({b})) / greatest(length({a}), length({b}))
   + 0.3::DOUBLE * ((CASE WHEN {a}[1:1] = {b}[1:1] THEN 1 ELSE 0 END + CASE WHEN {a}[1:2] = {b}[1:2] AND least(length({a}), length({b})) >= 2 THEN 1 ELSE 0 END + CASE WHEN {a}[1:3] = {b}[1:3] AND least(length({a}), length({b})) >= 3 THEN 1 ELSE 0 END
     + CASE WHEN {a}[1:4] = {b}[1:4] AND least(length({a}), length({b})) >= 4 THEN 1 ELSE 0 END + CASE WHEN {a}[1:5] = {b}[1:5] AND least(length({a}), length({b})) >= 5 THEN 1 ELSE 0 END) / 5.0::DOUBLE) END"""


@query("p30_name_similarity", f"SELECT a, b, round({SIM_SQL.format(a='a', b='b')}, 6) AS similarity FROM edges")
def p30(spark, sf):
    return V.edges(spark, sf).select("a", "b", F.round(names.name_similarity("a", "b"), 6).alias("similarity"))


@query(
    "p31_jaccard",
    """, s AS (SELECT item, list(attr) AS attrs FROM side_effects GROUP BY item)
    SELECT a, b, round(coalesce(len(list_intersect(x.attrs, y.attrs)) / len(list_distinct(list_concat(x.attrs, y.attrs)))::DOUBLE, 0), 6) AS jaccard
    FROM edges JOIN s x ON a = x.item JOIN s y ON b = y.item""",
)
def p31(spark, sf):
    pairs = pair_similarity(V.edges(spark, sf).select("a", "b"), V.side_effects(spark, sf), "jaccard")
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    "p32_readability",
    """SELECT doc_id, round(len(w) / greatest(len(s), 1)::DOUBLE, 6) AS avg_sentence_length, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)::DOUBLE, 6) AS vocabulary_richness
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS s FROM documents)""",
    views=False,
)
def p32(spark, sf):
    r = V.table(spark, sf, "documents").select("doc_id", text.readability("text").alias("r"))
    return r.select("doc_id", F.round("r.avg_sentence_length", 6).alias("avg_sentence_length"), F.round("r.vocabulary_richness", 6).alias("vocabulary_richness"))
