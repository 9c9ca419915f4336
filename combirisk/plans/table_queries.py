"""Registered queries of aggregations and windows (A and W rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from combirisk.functions import codes, rules, severity, text
from combirisk.functions.codes import code_level
from combirisk.operators import network as N
from combirisk.operators import profiles as A
from combirisk.operators import ranking as W
from combirisk.operators import statistics as S
from combirisk.operators.pairs import canonical, regimen_edges
from combirisk.plans import views as V
from combirisk.plans.check_views import lit
from combirisk.plans.join_queries import MECH_SQL, REFERENCE_SQL, reference_levels
from combirisk.plans.registry import query
from combirisk.plans.scalar_queries import CLASS_SQL, HYBRID_SQL, PAIR_CATEGORY_SQL
from combirisk.schemas import LABELS

METRICS = ["degree_centrality", "weighted_degree", "severity_profile", "pri"]
SEVERE_SQL = "('Contraindicated interaction', 'Major interaction')"


@query("a1_value_counts", f"SELECT mechanism, n, round(100.0 * n / (sum(n) OVER ())::DOUBLE, 2) AS pct FROM (SELECT {MECH_SQL} AS mechanism, count(*) AS n FROM interactions GROUP BY 1)")
def a1(spark, sf):
    return A.value_counts(V.interactions(spark, sf), text.mechanism("interaction_description"), "mechanism")


CELLS_SQL = ", ".join(f"count(*) FILTER (severity_label = {lit(v)}) AS n_{i}" for i, v in enumerate(LABELS))
PCTS_SQL = ", ".join(f"round(100.0 * n_{i} / total::DOUBLE, 2) AS pct_{i}" for i in range(len(LABELS)))


@query(
    "a2_crosstab",
    f""", r AS (SELECT {PAIR_CATEGORY_SQL} AS category, severity_label FROM interactions), t AS (SELECT category, {CELLS_SQL}, count(*) AS total FROM r GROUP BY 1 UNION ALL SELECT 'All', {CELLS_SQL}, count(*) FROM r)
    SELECT *, {PCTS_SQL} FROM t""",
)
def a2(spark, sf):
    flags = [F.col(c) for c in ("is_cardiovascular_1", "is_antithrombotic_1", "is_cardiovascular_2", "is_antithrombotic_2")]
    rows = V.interactions(spark, sf).select(codes.pair_category(*flags).alias("category"), "severity_label")
    return A.crosstab(rows, "category", "severity_label", LABELS)


SIDES_SQL = "(SELECT drug_name_1 AS item, * FROM interactions UNION ALL SELECT drug_name_2, * FROM interactions)"
COUNTS_SQL = ", ".join(f"count(*) FILTER ({{c}} = {lit(v)}) AS {n}" for v, n in zip(LABELS, ("contraindicated", "major", "moderate", "minor")))


@query("a3_item_counts", f"SELECT item, count(*) AS n, {COUNTS_SQL.format(c='severity_label')} FROM {SIDES_SQL} GROUP BY 1")
def a3(spark, sf):
    return A.item_counts(V.interactions(spark, sf))


PROFILE_SQL = """SELECT item, total, contraindicated, major, moderate, minor, avg_severity, is_cardiovascular, is_antithrombotic,
   (4 * contraindicated + 3 * major + 2 * moderate + minor) / greatest(total, 1)::DOUBLE AS risk_score
 FROM (SELECT item, count(*) AS total, count(*) FILTER (severity_label LIKE 'Contra%') AS contraindicated, count(*) FILTER (severity_label LIKE 'Major%') AS major,
   count(*) FILTER (severity_label LIKE 'Moderate%') AS moderate, count(*) FILTER (severity_label IS NULL OR severity_label LIKE 'Minor%') AS minor,
   avg(severity_numeric) AS avg_severity, bool_or(cv) AS is_cardiovascular, bool_or(thr) AS is_antithrombotic
   FROM (SELECT drug_name_1 AS item, severity_label, severity_numeric, is_cardiovascular_1 AS cv, is_antithrombotic_1 AS thr FROM interactions
         UNION ALL SELECT drug_name_2, severity_label, severity_numeric, is_cardiovascular_2, is_antithrombotic_2 FROM interactions) GROUP BY 1)"""


@query("a4_item_profiles", f"SELECT * REPLACE (round(avg_severity, 6) AS avg_severity, round(risk_score, 6) AS risk_score) FROM ({PROFILE_SQL})")
def a4(spark, sf):
    p = A.item_profiles(V.interactions(spark, sf))
    return p.withColumns({"avg_severity": F.round("avg_severity", 6), "risk_score": F.round("risk_score", 6)})


def item_classes(spark, sf):
    return V.items(spark, sf).select("item", codes.primary_class("codes").alias("drug_class"))


@query(
    "a5_class_matrix",
    f""", cls AS ({CLASS_SQL}), p AS (SELECT x.drug_class AS c1, y.drug_class AS c2, count(*) AS n FROM edges JOIN cls x ON a = x.item JOIN cls y ON b = y.item GROUP BY 1, 2)
    SELECT class1, class2, sum(n)::BIGINT AS n FROM (SELECT c1 AS class1, c2 AS class2, n FROM p UNION ALL SELECT c2, c1, n FROM p WHERE c1 <> c2) GROUP BY 1, 2""",
)
def a5(spark, sf):
    return A.class_matrix(V.edges(spark, sf), item_classes(spark, sf))


@query(
    "a6_phenotype_summary",
    f"SELECT *, round(100.0 * (contraindicated + major) / total::DOUBLE, 2) AS high_risk_pct FROM (SELECT phenotype, count(*) AS total, {COUNTS_SQL.format(c='label')} FROM (SELECT unnest(phenotypes) AS phenotype, label FROM tagged_edges) GROUP BY 1)",
)
def a6(spark, sf):
    return A.phenotype_summary(V.tagged_edges(spark, sf))


@query(
    "a6_top_phenotypes",
    "SELECT * FROM (SELECT label, phenotype, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, phenotype) AS rank FROM (SELECT unnest(phenotypes) AS phenotype, label FROM tagged_edges) GROUP BY 1, 2) WHERE rank <= 5",
)
def a6_top(spark, sf):
    return A.top_phenotypes(V.tagged_edges(spark, sf))


@query(
    "a7_phenotype_cooccurrence",
    """, j AS (SELECT p1, p2, count(*) AS n FROM (SELECT p1, unnest(phenotypes) AS p2 FROM (SELECT unnest(phenotypes) AS p1, phenotypes FROM tagged_edges)) GROUP BY 1, 2)
    SELECT x.p1, x.p2, x.n, round(x.n / y.n::DOUBLE, 6) AS p_given FROM j x JOIN j y ON y.p1 = x.p1 AND y.p2 = x.p1""",
)
def a7(spark, sf):
    return A.phenotype_cooccurrence(V.tagged_edges(spark, sf))


def coded_items(spark, sf, metrics=V.sampled_item_metrics):
    """(item, l1, l2, pri, severe, flagged) of every item in the network."""
    metrics = metrics(spark, sf).select("item", "pri", (F.col("contraindicated") + F.col("major")).alias("severe"))
    first = F.get("codes", F.lit(0))
    items = V.items(spark, sf).select(
        "item", F.coalesce(code_level(first, 1), F.lit("none")).alias("l1"), F.coalesce(code_level(first, 2), F.lit("none")).alias("l2"),
        (F.col("is_cardiovascular") | F.col("is_antithrombotic")).alias("flagged"),
    )
    return metrics.join(items, "item")


CODED_SQL = ", ci AS (SELECT p.item, coalesce(codes[1][1:1], 'none') AS l1, coalesce(codes[1][1:3], 'none') AS l2, pri, c4 + c3 AS severe, is_cardiovascular OR is_antithrombotic AS flagged FROM pri p JOIN items USING (item))"


@query(
    "a8_code_distribution",
    CODED_SQL + """ SELECT l1, coalesce(l2, 'all') AS l2, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ci)::DOUBLE, 4) AS pct, round(avg(pri), 6) AS mean_pri, round(max(pri), 6) AS max_pri FROM ci GROUP BY GROUPING SETS ((l1, l2), (l1))""",
    all_sources=True,
)
def a8(spark, sf):
    return A.code_distribution(coded_items(spark, sf, V.item_metrics))


@query(
    "a9_group_flow",
    """SELECT coalesce(g, '*') AS l1, coalesce(s, '*') AS severity, count(*) AS n FROM (SELECT coalesce(substr(regexp_extract(atc_1, '''([^'']+)''', 1), 1, 1), '') AS g, coalesce(severity_label, 'none') AS s FROM interactions) GROUP BY CUBE (g, s)""",
)
def a9(spark, sf):
    rows = V.interactions(spark, sf).select(
        F.coalesce(F.substring(F.regexp_extract("atc_1", "'([^']+)'", 1), 1, 1), F.lit("")).alias("l1"), F.coalesce("severity_label", F.lit("none")).alias("severity")
    )
    return A.group_flow(rows, "l1", "severity")


@query(
    "a10_dataset_summary",
    """SELECT 'rows' AS measure, count(*) AS value FROM interactions UNION ALL SELECT 'pairs', count(*) FROM edges UNION ALL SELECT 'unlabelled', count(*) FROM interactions WHERE severity_label IS NULL
    UNION ALL SELECT 'items', count(*) FROM nodes UNION ALL SELECT 'cardiovascular', count(*) FROM nodes JOIN items USING (item) WHERE is_cardiovascular UNION ALL SELECT 'antithrombotic', count(*) FROM nodes JOIN items USING (item) WHERE is_antithrombotic""",
)
def a10(spark, sf):
    return A.dataset_summary(V.interactions(spark, sf))


MOMENTS_SQL = (
    ", avgs AS (SELECT " + ", ".join(f"avg({m}) AS a_{m}" for m in METRICS) + " FROM pri), mom AS (SELECT "
    + ", ".join(
        f"avg(({m} - a_{m}) ** 3) / pow(avg(({m} - a_{m}) ** 2), 1.5) AS sk_{m}, avg(({m} - a_{m}) ** 4) / pow(avg(({m} - a_{m}) ** 2), 2) - 3 AS ku_{m}"
        for m in METRICS
    )
    + " FROM pri, avgs) "
)


@query(
    "a11_descriptive",
    MOMENTS_SQL
    + " UNION ALL ".join(
        f"SELECT {lit(m)} AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS sd, round(min({m}), 6) AS min,"
        f" round(quantile_cont({m}, 0.25), 6) AS q25, round(quantile_cont({m}, 0.5), 6) AS median, round(quantile_cont({m}, 0.75), 6) AS q75,"
        f" round(max({m}), 6) AS max, round(max(sk_{m}), 4) AS skew, round(max(ku_{m}), 4) AS kurtosis FROM pri, mom"
        for m in METRICS
    ),
    all_sources=True,
)
def a11(spark, sf):
    return S.descriptive(V.item_metrics(spark, sf), METRICS)


PAIRS = [(x, y) for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]]


@query("a12_pearson", " UNION ALL ".join(f"SELECT {lit(x)} AS x, {lit(y)} AS y, round(corr({x}, {y}), 6) AS r FROM pri" for x, y in PAIRS))
def a12(spark, sf):
    return S.correlation_matrix(V.sampled_item_metrics(spark, sf), METRICS)


RANKED_SQL = ", rk AS (SELECT item, " + ", ".join(f"rank() OVER (ORDER BY round({m}, 9)) + (count(*) OVER (PARTITION BY round({m}, 9)) - 1) / 2.0 AS {m}" for m in METRICS) + " FROM pri)"


@query("a12_spearman", RANKED_SQL + " UNION ALL ".join(f" SELECT {lit(x)} AS x, {lit(y)} AS y, round(corr({x}, {y}), 6) AS r FROM rk" for x, y in PAIRS))
def a12_spearman(spark, sf):
    metrics = V.sampled_item_metrics(spark, sf).select("item", *[F.round(m, 9).alias(m) for m in METRICS])
    return S.correlation_matrix(metrics, METRICS, "spearman")


@query(
    "a13_group_summary",
    "SELECT severity_label, count(severity_confidence) AS n, round(avg(severity_confidence), 2) AS mean, round(stddev_samp(severity_confidence), 2) AS sd, round(min(severity_confidence), 2) AS min, round(max(severity_confidence), 2) AS max FROM interactions GROUP BY 1",
)
def a13(spark, sf):
    return A.group_summary(V.interactions(spark, sf), "severity_label", "severity_confidence")


GRAPH_NODES_SQL = """SELECT item AS id, 'drug' AS kind FROM items UNION ALL SELECT DISTINCT attr, 'protein' FROM proteins UNION ALL SELECT DISTINCT 'SE:' || attr, 'side_effect' FROM side_effects
  UNION ALL SELECT DISTINCT 'DIS:' || attr, 'disease' FROM diseases UNION ALL SELECT DISTINCT attr, 'pathway' FROM pathways UNION ALL SELECT DISTINCT 'CAT:' || kind, 'category' FROM items"""
GRAPH_EDGES_SQL = """SELECT a AS src, b AS dst, 'ddi' AS kind FROM edges UNION ALL SELECT item, attr, 'drug_protein' FROM proteins UNION ALL SELECT item, 'SE:' || attr, 'drug_side_effect' FROM side_effects
  UNION ALL SELECT item, 'DIS:' || attr, 'drug_disease' FROM diseases UNION ALL SELECT item, attr, 'drug_pathway' FROM pathways UNION ALL SELECT item, 'CAT:' || kind, 'drug_category' FROM items"""


def property_graph(spark, sf):
    items, p, s = V.items(spark, sf), V.proteins(spark, sf), V.side_effects(spark, sf)
    d, w, e = V.diseases(spark, sf), V.pathways(spark, sf), V.edges(spark, sf)
    tag = lambda t: F.concat(F.lit(t), F.col("attr"))
    category = F.concat(F.lit("CAT:"), F.col("kind"))
    link = lambda df, dst: df.select(F.col("item").alias("src"), dst.alias("dst"))
    nodes = {
        "drug": items.select(F.col("item").alias("id"), "drug_id", "atc"),
        "protein": p.select(F.col("attr").alias("id")),
        "side_effect": s.select(tag("SE:").alias("id"), F.col("attr").alias("name")),
        "disease": d.select(tag("DIS:").alias("id"), F.col("attr").alias("name")),
        "pathway": w.select(F.col("attr").alias("id")),
        "category": items.select(category.alias("id"), F.col("kind").alias("name")),
    }
    links = {
        "ddi": e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "label", "description"),
        "drug_protein": link(p, F.col("attr")),
        "drug_side_effect": link(s, tag("SE:")),
        "drug_disease": link(d, tag("DIS:")),
        "drug_pathway": link(w, F.col("attr")),
        "drug_category": link(items, category),
    }
    return N.property_graph(nodes, links)


@query(
    "a14_graph_statistics",
    f", t AS (SELECT 'nodes' AS part, kind FROM ({GRAPH_NODES_SQL}) UNION ALL SELECT 'edges', kind FROM ({GRAPH_EDGES_SQL})) SELECT part, coalesce(kind, '*') AS kind, count(*) AS n FROM t GROUP BY GROUPING SETS ((part, kind), (part))",
)
def a14(spark, sf):
    return A.graph_statistics(*property_graph(spark, sf))


# Target shares of the recalibration.
TARGET = dict(zip(LABELS, (0.04, 0.18, 0.74, 0.04)))


@query(
    "a15_drift",
    f""", c AS (SELECT severity_label AS old, recal AS new, count(*) AS n FROM ({HYBRID_SQL}) GROUP BY 1, 2), t AS (SELECT sum(n)::DOUBLE AS total, sum(n) FILTER (old IS DISTINCT FROM new) AS changed FROM c)
    SELECT old, new, n, round(sum(n) OVER (PARTITION BY old) / total, 6) AS old_share, round(sum(n) OVER (PARTITION BY new) / total, 6) AS new_share,
      CASE new {' '.join(f'WHEN {lit(k)} THEN {v}::DOUBLE' for k, v in TARGET.items())} END AS target_share, round(changed / total, 6) AS change_rate FROM c, t""",
)
def a15(spark, sf):
    return A.drift(severity.hybrid_recalibration(V.interactions(spark, sf)), "severity_label", "severity_recalibrated", TARGET)


@query(
    "a15_method_counts",
    f"SELECT method, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, count(*) FILTER (severity_label IS DISTINCT FROM recal) AS changed, round(avg(recal_confidence), 6) AS mean_confidence FROM ({HYBRID_SQL}) GROUP BY 1",
)
def a15_methods(spark, sf):
    rows = severity.hybrid_recalibration(V.interactions(spark, sf))
    return A.method_counts(rows, "recal_method", "severity_label", "severity_recalibrated", "recal_confidence")


@query(
    "a15_divergence",
    f""", r AS ({HYBRID_SQL}), c AS (SELECT l, sum(o)::DOUBLE AS o, sum(k)::DOUBLE AS k FROM (SELECT severity_label AS l, 1 AS o, 0 AS k FROM r UNION ALL SELECT recal, 0, 1 FROM r) GROUP BY 1),
    s AS (SELECT o / sum(o) OVER () AS p, k / sum(k) OVER () AS q FROM c)
    SELECT round(sum(((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS divergence FROM s""",
)
def a15_divergence(spark, sf):
    return A.shannon_divergence(severity.hybrid_recalibration(V.interactions(spark, sf)), "severity_label", "severity_recalibrated")


@query(
    "a16_subset_rates",
    f"""SELECT count(*) AS n, round(avg(CASE WHEN recal IN {SEVERE_SQL} THEN 1.0 ELSE 0.0 END), 6) AS severe_rate, round(avg(CASE WHEN recal = 'Moderate interaction' THEN 1.0 ELSE 0.0 END), 6) AS moderate_rate, round(avg(recal_confidence), 6) AS mean_confidence, round(avg(recal_confidence - severity_confidence), 6) AS confidence_shift
    FROM ({HYBRID_SQL}) WHERE (list_contains(c1, 'anticoagulants') AND list_contains(c2, 'antiplatelets')) OR (list_contains(c2, 'anticoagulants') AND list_contains(c1, 'antiplatelets'))""",
)
def a16(spark, sf):
    one, two = (severity.name_classes(F.col(f"drug_name_{i}"), rules.RISK_CLASSES) for i in (1, 2))
    has = F.array_contains
    subset = (has(one, "anticoagulants") & has(two, "antiplatelets")) | (has(two, "anticoagulants") & has(one, "antiplatelets"))
    return A.subset_rates(severity.hybrid_recalibration(V.interactions(spark, sf)), subset, "severity_recalibrated", "recal_confidence", "severity_confidence")


@query(
    "a17_consensus",
    f""", d3 AS (SELECT level, 100.0 * count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM ({REFERENCE_SQL}) WHERE level <> 'Unknown' GROUP BY 1),
    d4 AS (SELECT level, 100.0 * count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM (SELECT CASE WHEN death THEN 'Contraindicated' WHEN serious THEN 'Major' WHEN reaction IN ('cardiac arrest', 'bleeding', 'seizure') THEN 'Moderate' ELSE 'Minor' END AS level FROM reports) GROUP BY 1),
    r AS (SELECT c.share / (c.share + m.share) AS ratio FROM d4 c, d4 m WHERE c.level = 'Contraindicated' AND m.level = 'Major'),
    s AS (SELECT 'Contraindicated' AS level, share * ratio AS a FROM d3, r WHERE level = 'Major' UNION ALL SELECT 'Major', share * (1 - ratio) FROM d3, r WHERE level = 'Major' UNION ALL SELECT level, share FROM d3 WHERE level <> 'Major'),
    j AS (SELECT level, (a + b) / 2 AS average, a * 0.5 + b * 0.5 AS weighted, CASE WHEN level IN ('Contraindicated', 'Major') THEN least(a, b) ELSE (a + b) / 2 END AS conservative,
      CASE level WHEN 'Contraindicated' THEN b * 0.25 WHEN 'Major' THEN (a + b * 0.67) / 2 WHEN 'Moderate' THEN a * 0.7 + b * 0.3 ELSE a END AS clinical FROM (SELECT s.level, a, share AS b FROM s JOIN d4 USING (level))),
    n AS (SELECT level, 100.0 * average / sum(average) OVER () AS average, 100.0 * weighted / sum(weighted) OVER () AS weighted, 100.0 * conservative / sum(conservative) OVER () AS conservative, 100.0 * clinical / sum(clinical) OVER () AS clinical FROM j)
    SELECT level, round(average, 6) AS average, round(weighted, 6) AS weighted, round(conservative, 6) AS conservative, round(clinical, 6) AS clinical, round((average + weighted + conservative + clinical) / 4, 6) AS consensus FROM n""",
)
def a17(spark, sf):
    three = A.value_counts(reference_levels(spark, sf).filter("level <> 'Unknown'"), "level", "level", 12).select("level", F.col("pct").alias("share"))
    outcome = (
        F.when(F.col("death"), "Contraindicated").when(F.col("serious"), "Major")
        .when(F.col("reaction").isin("cardiac arrest", "bleeding", "seizure"), "Moderate").otherwise("Minor")
    )
    four = A.value_counts(V.reports(spark, sf), outcome, "level", 12).select("level", F.col("pct").alias("share"))
    return A.consensus_distribution(A.rescale_three_to_four(three, four))


@query(
    "a18_confidence_distribution",
    "SELECT severity_label AS label, CAST(least(floor(round(severity_confidence * 10, 9)), 9) AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (severity_confidence > 0.8) AS high FROM interactions GROUP BY 1, 2",
)
def a18(spark, sf):
    return A.confidence_distribution(V.interactions(spark, sf), "severity_label", "severity_confidence")


ZONE_BODY = "count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ci)::DOUBLE, 4) AS pct, round(avg(pri), 6) AS mean_pri, round(avg(severe), 6) AS mean_severe, round(100.0 * avg(flagged::INT), 4) AS flagged_pct FROM ci GROUP BY 1"


@query(
    "a19_risk_zones",
    CODED_SQL + f""" SELECT *, 'right' AS closed FROM (SELECT CASE WHEN pri <= 0 THEN NULL WHEN pri <= 0.2 THEN 'low' WHEN pri <= 0.35 THEN 'moderate' WHEN pri <= 0.5 THEN 'high' WHEN pri <= 1 THEN 'critical' END AS zone, {ZONE_BODY})
    UNION ALL SELECT *, 'left' FROM (SELECT CASE WHEN pri < 0.2 THEN 'low' WHEN pri < 0.35 THEN 'moderate' WHEN pri < 0.5 THEN 'high' WHEN pri <= 1 THEN 'critical' END AS zone, {ZONE_BODY})""",
)
def a19(spark, sf):
    items = coded_items(spark, sf)
    right = A.zone_table(items, A.risk_zone(F.col("pri"))).withColumn("closed", F.lit("right"))
    return right.unionByName(A.zone_table(items, A.risk_zone(F.col("pri"), right_closed=False)).withColumn("closed", F.lit("left")))


@query(
    "a20_class_pair_rates",
    f""", cls AS ({CLASS_SQL}) SELECT *, round(100.0 * severe / total::DOUBLE, 4) AS rate FROM (SELECT least(x.drug_class, y.drug_class) AS class1, greatest(x.drug_class, y.drug_class) AS class2, count(*) AS total, count(*) FILTER (label IN {SEVERE_SQL}) AS severe
    FROM edges JOIN cls x ON a = x.item JOIN cls y ON b = y.item GROUP BY 1, 2) WHERE total > 100""",
)
def a20(spark, sf):
    return A.class_pair_rates(V.edges(spark, sf), item_classes(spark, sf), 100)


PROFILE_COLUMNS = ["drug_name_1", "atc_1", "interaction_description", "severity_label", "severity_confidence", "severity_numeric"]


@query(
    "a21_null_profile",
    " UNION ALL ".join(f"SELECT {lit(c)} AS column, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*)::DOUBLE, 4) AS pct FROM interactions" for c in PROFILE_COLUMNS),
)
def a21(spark, sf):
    return A.null_profile(V.interactions(spark, sf).select(*PROFILE_COLUMNS))


DESCRIBED = ["severity_confidence", "severity_numeric"]


@query(
    "a21_description",
    " UNION ALL ".join(
        f"SELECT {lit(c)} AS column, count({c}) AS count, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, round(min({c}::DOUBLE), 6) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c}::DOUBLE), 6) AS max FROM interactions"
        for c in DESCRIBED
    ),
)
def a21_description(spark, sf):
    return S.describe(V.interactions(spark, sf), DESCRIBED)


@query(
    "a22_modal_label",
    f""", c AS (SELECT item, severity_label AS l, count(*) AS n FROM {SIDES_SQL} WHERE severity_label IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT item, l AS modal, n, total FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, l) AS rn, sum(n) OVER (PARTITION BY item) AS total FROM c) WHERE rn = 1)
    SELECT item, modal, n, total::BIGINT AS total, rank FROM (SELECT *, row_number() OVER (PARTITION BY modal ORDER BY total DESC, item) AS rank FROM m) WHERE rank <= 10""",
)
def a22(spark, sf):
    modal = A.modal_label(A.both_sides(V.interactions(spark, sf), "severity_label"))
    return W.top_k_per_group(modal, ["modal"], 10, F.desc("total"), F.asc("item"))


@query(
    "a23_histogram",
    ", b AS (SELECT min(pri) AS lo, max(pri) AS hi FROM pri) SELECT CAST(least(floor(round((pri - lo) / (hi - lo) * 50, 9)), 49) AS INTEGER) AS bucket, count(*) AS n FROM pri, b GROUP BY 1",
)
def a23(spark, sf):
    return A.histogram(V.sampled_item_metrics(spark, sf).select("pri"), "pri")


@query(
    "a23_box_statistics",
    CODED_SQL + " SELECT flagged, count(pri) AS n, round(min(pri), 6) AS min, round(quantile_cont(pri, 0.25), 6) AS q25, round(quantile_cont(pri, 0.5), 6) AS q50, round(quantile_cont(pri, 0.75), 6) AS q75, round(max(pri), 6) AS max FROM ci GROUP BY 1",
)
def a23_box(spark, sf):
    return A.box_statistics(coded_items(spark, sf), "flagged", "pri")


@query(
    "a24_high_risk_subset",
    """SELECT is_cardiovascular_1, count(*) AS n, round(avg(severity_confidence), 6) AS mean, round(stddev_samp(severity_confidence), 6) AS sd FROM interactions WHERE severity_label = 'Contraindicated interaction' AND severity_confidence > 0.7 GROUP BY 1""",
)
def a24(spark, sf):
    return A.high_risk_rows(V.interactions(spark, sf)).groupBy("is_cardiovascular_1").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("severity_confidence"), 6).alias("mean"), F.round(F.stddev_samp("severity_confidence"), 6).alias("sd")
    )


@query(
    "a25_category_members",
    """, s AS (SELECT l2, count(*) AS size FROM (SELECT item, coalesce(codes[1][1:3], 'none') AS l2 FROM items) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT * FROM (SELECT i.l2, size, item, row_number() OVER (PARTITION BY i.l2 ORDER BY item) AS rank FROM (SELECT item, coalesce(codes[1][1:3], 'none') AS l2 FROM items) i JOIN s ON i.l2 = s.l2) WHERE rank <= 5""",
)
def a25(spark, sf):
    items = V.items(spark, sf).select("item", F.coalesce(code_level(F.get("codes", F.lit(0)), 2), F.lit("none")).alias("l2"))
    return A.category_members(items, "l2")


@query("w1_top_items", "SELECT item, degree, round(pri, 6) AS pri FROM pri ORDER BY round(pri, 6) DESC, item LIMIT 20")
def w1(spark, sf):
    metrics = V.sampled_item_metrics(spark, sf).select("item", "degree", F.round("pri", 6).alias("pri"))
    return W.top_k(metrics, 20, F.desc("pri"), F.asc("item"))


@query("w2_top_per_group", CODED_SQL + " SELECT l1, item, round(pri, 6) AS pri, rank FROM (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY round(pri, 6) DESC, item) AS rank FROM ci) WHERE rank <= 5", all_sources=True)
def w2(spark, sf):
    items = coded_items(spark, sf, V.item_metrics).select("l1", "item", F.round("pri", 6).alias("pri"))
    return W.top_k_per_group(items, ["l1"], 5, F.desc("pri"), F.asc("item"))


@query(
    "w3_keep_first",
    "SELECT drug_name_1, drug_name_2, d, severity_confidence FROM (SELECT drug_name_1, drug_name_2, coalesce(interaction_description, '') AS d, severity_confidence, row_number() OVER (PARTITION BY drug_name_1, drug_name_2 ORDER BY coalesce(interaction_description, ''), severity_confidence) AS rn FROM interactions) WHERE rn = 1",
)
def w3(spark, sf):
    rows = V.interactions(spark, sf).select("drug_name_1", "drug_name_2", F.coalesce("interaction_description", F.lit("")).alias("d"), "severity_confidence")
    return W.keep_first(rows, ["drug_name_1", "drug_name_2"], F.asc("d"), F.asc("severity_confidence"))


@query("w4_keep_max_edge", "SELECT a, b, numeric AS severity, description, confidence FROM edges")
def w4(spark, sf):
    rows = canonical(V.interactions(spark, sf)).withColumnRenamed("numeric", "severity")
    return W.keep_max(rows, ["a", "b"], "severity", "description", "confidence")


@query("w5_average_ranks", "SELECT item, degree, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0::DOUBLE AS rank FROM metrics")
def w5(spark, sf):
    return S.average_ranks(N.degree_table(V.edges(spark, sf)).select("item", "degree"), "degree", "rank")


@query(
    "w6_cumulative_share",
    """SELECT DISTINCT wsum AS value, round(count(*) OVER (ORDER BY wsum DESC RANGE UNBOUNDED PRECEDING) / (count(*) OVER ())::DOUBLE, 6) AS row_share, round(sum(wsum) OVER (ORDER BY wsum DESC RANGE UNBOUNDED PRECEDING) / sum(wsum) OVER (), 6) AS value_share FROM metrics""",
)
def w6(spark, sf):
    shares = S.cumulative_share(N.degree_table(V.edges(spark, sf)), "weight_sum")
    return shares.select("value", F.round("row_share", 6).alias("row_share"), F.round("value_share", 6).alias("value_share"))


@query(
    "w7_quantile_bins",
    """, q AS (SELECT list_sort(list_distinct(quantile_cont(degree, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM metrics)
    SELECT bin, count(*) AS n, min(degree) AS lo, max(degree) AS hi FROM (SELECT degree, greatest(len(list_filter(e, lambda v: v < degree)) - 1, 0) AS bin FROM metrics, q) GROUP BY 1""",
)
def w7(spark, sf):
    binned = S.quantile_bins(N.degree_table(V.edges(spark, sf)), "degree")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("degree").alias("lo"), F.max("degree").alias("hi"))


RANK_SQL = "CASE label WHEN 'Contraindicated interaction' THEN 0 WHEN 'Major interaction' THEN 1 WHEN 'Moderate interaction' THEN 2 WHEN 'Minor interaction' THEN 3 ELSE 4 END"


@query("w8_sorted_findings", f"SELECT regimen_id, a, b, label, row_number() OVER (PARTITION BY regimen_id ORDER BY {RANK_SQL}, a, b) AS place, {RANK_SQL} AS severity_rank FROM regimen_edges")
def w8(spark, sf):
    return W.sorted_findings(regimen_edges(V.regimens(spark, sf), V.edges(spark, sf)).select("regimen_id", "a", "b", "label"))


@query("w9_unions", f"SELECT 'all' AS kind, count(*) AS n FROM {SIDES_SQL} UNION ALL SELECT 'distinct', count(DISTINCT item) FROM {SIDES_SQL}")
def w9(spark, sf):
    rows = V.interactions(spark, sf)
    stacked = rows.select(F.col("drug_name_1").alias("item")).unionByName(rows.select(F.col("drug_name_2").alias("item")))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(stacked, "all").unionByName(count(stacked.distinct(), "distinct"))


@query(
    "w10_set_changes",
    """, p AS (SELECT item, list_sort(list_distinct(flatten(list(phenotypes)))) AS ph FROM (SELECT a AS item, phenotypes FROM tagged_edges UNION ALL SELECT b, phenotypes FROM tagged_edges) GROUP BY 1)
    SELECT a, b, array_to_string(list_filter(x.ph, lambda v: NOT list_contains(y.ph, v)), '|') AS avoided, array_to_string(list_filter(y.ph, lambda v: NOT list_contains(x.ph, v)), '|') AS introduced,
      array_to_string(list_filter(x.ph, lambda v: list_contains(y.ph, v)), '|') AS kept FROM edges JOIN p x ON a = x.item JOIN p y ON b = y.item""",
)
def w10(spark, sf):
    edges = V.tagged_edges(spark, sf)
    tags = edges.select(F.explode(F.array("a", "b")).alias("item"), "phenotypes").select("item", F.explode_outer("phenotypes").alias("p")).distinct()
    sets = tags.groupBy("item").agg(F.array_sort(F.collect_set("p")).alias("ph"))
    one, two = sets.select(F.col("item").alias("a"), F.col("ph").alias("x")), sets.select(F.col("item").alias("b"), F.col("ph").alias("y"))
    rows = W.set_changes(edges.select("a", "b").join(one, "a").join(two, "b"), "x", "y")
    return rows.select("a", "b", *[F.array_join(c, "|").alias(c) for c in ("avoided", "introduced", "kept")])


@query("w11_high_risk_combinations", "SELECT DISTINCT drug_name_1, drug_name_2, severity_numeric FROM interactions WHERE severity_numeric >= 4")
def w11(spark, sf):
    return V.interactions(spark, sf).filter("severity_numeric >= 4").select("drug_name_1", "drug_name_2", "severity_numeric").distinct()

