"""Registered queries of regimen risk (H rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from combirisk.functions import codes, rules
from combirisk.operators import attributes as A
from combirisk.operators import network as N
from combirisk.operators import regimen as H
from combirisk.operators.pairs import regimen_edges, regimen_sizes
from combirisk.plans import views as V
from combirisk.plans.check_views import any_contains, lit
from combirisk.plans.join_queries import PREFIX_SQL
from combirisk.plans.registry import query
from combirisk.plans.table_queries import SEVERE_SQL
from combirisk.schemas import LABELS
from combirisk.session import cut_lineage

COUNTS_SQL = ", ".join(f"count(*) FILTER (label = {lit(v)}) AS {n}" for v, n in zip(LABELS, ("c4", "c3", "c2", "c1")))


def base(spark, sf):
    """(regimens, edges with phenotypes, regimen edges)."""
    regs, edges = V.regimens(spark, sf), cut_lineage(V.tagged_edges(spark, sf))
    return regs, edges, regimen_edges(regs, edges)


def network_risk_sql(pheno: int, inter: int, c: int, m: int, o: int) -> str:
    return f""", per AS (SELECT regimen_id, count(*) AS k, {COUNTS_SQL}, len(list_distinct(flatten(list(phenotypes)))) AS ph FROM regimen_edges GROUP BY 1),
    mem AS (SELECT regimen_id, count(*) AS n_items, avg(pri) AS mean FROM regimens JOIN pri USING (item) GROUP BY 1),
    best AS (SELECT regimen_id, item AS top_item, pri AS top FROM (SELECT regimen_id, item, pri, row_number() OVER (PARTITION BY regimen_id ORDER BY pri DESC, item) AS rn FROM regimens JOIN pri USING (item)) WHERE rn = 1),
    s AS (SELECT mem.*, coalesce(k, 0) AS k, coalesce(c4, 0) AS c4, coalesce(c3, 0) AS c3, coalesce(c2, 0) AS c2, coalesce(c1, 0) AS c1, coalesce(ph, 0) AS ph,
       least(100.0::DOUBLE, 30 * mean + {c} * coalesce(c4, 0) + {m} * coalesce(c3, 0) + {o} * coalesce(c2, 0) + {pheno} * coalesce(ph, 0) + {inter} * coalesce(k, 0)) AS score FROM mem LEFT JOIN per USING (regimen_id))
    SELECT regimen_id, n_items, k AS interactions, c4 AS contraindicated, c3 AS major, c2 AS moderate, c1 AS minor, ph AS phenotypes, round(mean, 6) AS mean, round(top, 6) AS top, top_item, round(score, 2) AS risk_score,
      CASE WHEN score >= 70 OR c4 > 0 THEN 'CRITICAL' WHEN score >= 50 OR c3 >= 2 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM s JOIN best USING (regimen_id)"""


def network_risk(spark, sf, weights):
    regs, edges, found = base(spark, sf)
    risk = H.network_risk(regs, found, V.sampled_item_metrics(spark, sf), weights)
    return risk.withColumns({"mean": F.round("mean", 6), "top": F.round("top", 6)})


@query("h1_regimen_network_risk", network_risk_sql(5, 0, 15, 8, 3))
def h1(spark, sf):
    return network_risk(spark, sf, H.NETWORK_SCORE)


@query("h11_regimen_demo_risk", network_risk_sql(0, 2, 20, 10, 4))
def h11(spark, sf):
    return network_risk(spark, sf, H.DEMO_SCORE)


PARTS_SQL = f""", dd AS (SELECT regimen_id, sum(weight) AS w, {COUNTS_SQL} FROM regimen_edges GROUP BY 1),
  sp AS (SELECT regimen_id, p.a, p.b, least(5, count(*) FILTER ({any_contains('lower(x.attr)', rules.HIGH_RISK_EFFECTS)})) AS high FROM regimen_pairs p JOIN side_effects x ON x.item = p.a JOIN side_effects y ON y.item = p.b AND y.attr = x.attr GROUP BY 1, 2, 3),
  se AS (SELECT regimen_id, count(*) AS pairs, sum(high) AS high, count(*) FILTER (high > 0) AS high_pairs FROM sp GROUP BY 1),
  pp AS (SELECT regimen_id, count(DISTINCT (p.a, p.b)) AS pairs FROM regimen_pairs p JOIN proteins x ON x.item = p.a JOIN proteins y ON y.item = p.b AND y.attr = x.attr GROUP BY 1),
  pw AS (SELECT regimen_id, count(DISTINCT (p.a, p.b)) AS pairs FROM regimen_pairs p JOIN pathways x ON x.item = p.a JOIN pathways y ON y.item = p.b AND y.attr = x.attr GROUP BY 1),
  nw AS (SELECT regimen_id, avg(coalesce(weighted_degree, 0)) AS v FROM regimens LEFT JOIN metrics USING (item) GROUP BY 1),
  parts AS (SELECT s.regimen_id, n, CASE WHEN n > 1 THEN coalesce(w, 0) / (10.0 * n * (n - 1) / 2)::DOUBLE ELSE 0 END AS ddi_risk,
    least(1.0::DOUBLE, 0.5 * (CASE WHEN n > 1 THEN coalesce(se.pairs, 0) / (n * (n - 1) / 2)::DOUBLE ELSE 0 END) + 0.5 * least(1.0::DOUBLE, coalesce(high, 0) / (2.0::DOUBLE * n))) AS effect_risk, coalesce(high_pairs, 0) AS high_pairs,
    CASE WHEN n > 1 THEN coalesce(pp.pairs, 0) / (n * (n - 1) / 2)::DOUBLE ELSE 0 END AS protein_risk, coalesce(pp.pairs, 0) AS protein_pairs,
    CASE WHEN n > 1 THEN coalesce(pw.pairs, 0) / (n * (n - 1) / 2)::DOUBLE ELSE 0 END AS pathway_risk, coalesce(pw.pairs, 0) AS pathway_pairs, nw.v AS network_risk,
    coalesce(c4, 0) AS c4, coalesce(c3, 0) AS c3 FROM regimen_size s LEFT JOIN dd USING (regimen_id) LEFT JOIN se USING (regimen_id) LEFT JOIN pp USING (regimen_id) LEFT JOIN pw USING (regimen_id) LEFT JOIN nw USING (regimen_id)),
  five AS (SELECT *, CASE WHEN overall >= 0.8 THEN 'CRITICAL' WHEN overall >= 0.6 THEN 'HIGH' WHEN overall >= 0.4 THEN 'MODERATE' WHEN overall >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level
    FROM (SELECT *, CASE WHEN n >= 2 THEN round(0.40 * ddi_risk + 0.25 * effect_risk + 0.15 * protein_risk + 0.10 * pathway_risk + 0.10 * network_risk, 9) ELSE 0.0 END AS overall FROM parts))"""


def five_part(spark, sf, regs=None):
    regs = V.regimens(spark, sf) if regs is None else regs
    edges = cut_lineage(V.edges(spark, sf))
    return H.five_part_risk(regs, edges, V.sampled_item_metrics(spark, sf), V.side_effects(spark, sf), V.proteins(spark, sf), V.pathways(spark, sf))


@query(
    "h2_five_part_risk",
    PARTS_SQL + " SELECT regimen_id, n, round(ddi_risk, 6) AS ddi_risk, round(effect_risk, 6) AS effect_risk, round(protein_risk, 6) AS protein_risk, round(pathway_risk, 6) AS pathway_risk, round(network_risk, 6) AS network_risk, round(overall, 9) AS overall, risk_level FROM five",
)
def h2(spark, sf):
    parts = ["ddi_risk", "effect_risk", "protein_risk", "pathway_risk", "network_risk", "overall"]
    return five_part(spark, sf).select("regimen_id", "n", *[F.round(c, 9 if c == "overall" else 6).alias(c) for c in parts], "risk_level")


@query("h2a_interaction_part", PARTS_SQL + " SELECT regimen_id, round(ddi_risk, 6) AS ddi_risk FROM parts")
def h2a(spark, sf):
    regs, _, found = base(spark, sf)
    return H.interaction_part(found, regimen_sizes(regs)).select("regimen_id", F.round("ddi_risk", 6).alias("ddi_risk"))


@query("h2b_effect_part", PARTS_SQL + " SELECT regimen_id, round(effect_risk, 6) AS effect_risk, high_pairs FROM parts")
def h2b(spark, sf):
    regs = V.regimens(spark, sf)
    part = H.effect_part(regs, V.side_effects(spark, sf), regimen_sizes(regs))
    return part.select("regimen_id", F.round("effect_risk", 6).alias("effect_risk"), "high_pairs")


@query("h2c_overlap_parts", PARTS_SQL + " SELECT regimen_id, round(protein_risk, 6) AS protein_risk, protein_pairs, round(pathway_risk, 6) AS pathway_risk, pathway_pairs, round(network_risk, 6) AS network_risk FROM parts")
def h2c(spark, sf):
    regs = V.regimens(spark, sf)
    sizes = regimen_sizes(regs)
    one = H.overlap_part(regs, V.proteins(spark, sf), sizes, "protein")
    two = H.overlap_part(regs, V.pathways(spark, sf), sizes, "pathway")
    three = H.network_part(regs, V.sampled_item_metrics(spark, sf))
    joined = one.join(two, "regimen_id").join(three, "regimen_id")
    return joined.select("regimen_id", F.round("protein_risk", 6).alias("protein_risk"), "protein_pairs", F.round("pathway_risk", 6).alias("pathway_risk"), "pathway_pairs", F.round("network_risk", 6).alias("network_risk"))


@query(
    "h2d_messages",
    PARTS_SQL + """ SELECT regimen_id, CASE WHEN n < 2 THEN 'Need at least 2 drugs for polypharmacy risk.' WHEN m = '' THEN 'No critical risks identified. Continue routine monitoring.' ELSE m END AS messages FROM (SELECT regimen_id, n, concat_ws(' | ',
      CASE risk_level WHEN 'CRITICAL' THEN 'CRITICAL RISK: Immediate review recommended.' WHEN 'HIGH' THEN 'HIGH RISK: Close monitoring required.' END,
      CASE WHEN c4 > 0 THEN c4 || ' CONTRAINDICATED interaction(s) detected.' END, CASE WHEN c3 > 0 THEN c3 || ' MAJOR interaction(s) require monitoring.' END,
      CASE WHEN high_pairs > 0 THEN high_pairs || ' drug pair(s) share serious side effect risks.' END, CASE WHEN protein_pairs > 0 THEN protein_pairs || ' drug pair(s) share protein targets.' END) AS m FROM five)""",
)
def h2d(spark, sf):
    return H.messages(five_part(spark, sf)).select("regimen_id", F.array_join("messages", " | ").alias("messages"))


@query(
    "h3_severity_score",
    """, p AS (SELECT regimen_id, sum(weight) AS w, count(*) AS k, max(numeric) AS worst FROM regimen_edges GROUP BY 1), s AS (SELECT regimen_id, n, coalesce(k, 0) AS k, worst, CASE WHEN k > 0 THEN least(100.0::DOUBLE, w / (10.0::DOUBLE * k) * 100) ELSE 0 END AS score FROM regimen_size LEFT JOIN p USING (regimen_id))
    SELECT regimen_id, n, k AS interactions, round(score, 2) AS score, worst, CASE WHEN k = 0 THEN 'NO_RISK' WHEN score >= 70 OR worst = 4 THEN 'CRITICAL' WHEN score >= 50 OR worst = 3 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM s""",
)
def h3(spark, sf):
    regs, _, found = base(spark, sf)
    return H.severity_score(regs, found)


SHARE_CASE = "CASE numeric WHEN 4 THEN 100 WHEN 3 THEN 70 WHEN 2 THEN 40 ELSE 15 END"


@query(
    "h4_mean_share_score",
    f""", p AS (SELECT regimen_id, sum({SHARE_CASE}) AS h, count(*) AS k, {COUNTS_SQL} FROM regimen_edges GROUP BY 1)
    SELECT regimen_id, round(CASE WHEN k > 0 THEN least(1.0::DOUBLE, h / 100.0::DOUBLE / k) ELSE 0 END, 6) AS score, coalesce(c4, 0) AS contraindicated, coalesce(c3, 0) AS major, coalesce(c2, 0) AS moderate, coalesce(c1, 0) AS minor FROM regimen_size LEFT JOIN p USING (regimen_id)""",
)
def h4(spark, sf):
    regs, _, found = base(spark, sf)
    return H.mean_share_score(regs, found)


@query(
    "h5_confidence_weighted",
    """, p AS (SELECT least(drug_name_1, drug_name_2) AS a, greatest(drug_name_1, drug_name_2) AS b, sum((CASE severity_numeric WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END) * round(severity_confidence * 100)) AS points, count(*) AS n FROM interactions GROUP BY 1, 2)
    SELECT regimen_id, coalesce(sum(points), 0) / 100.0::DOUBLE AS score, coalesce(sum(p.n), 0)::BIGINT AS rows FROM regimen_size LEFT JOIN (regimen_pairs r JOIN p USING (a, b)) USING (regimen_id) GROUP BY 1""",
)
def h5(spark, sf):
    return H.confidence_weighted(V.regimens(spark, sf), V.interactions(spark, sf))


@query(
    "h6_additive_scores",
    f""", p AS (SELECT regimen_id, {COUNTS_SQL} FROM regimen_edges GROUP BY 1), s AS (SELECT regimen_id, least(1.0::DOUBLE, round(0.4 * (c4 + c3) + 0.2 * c2 + 0.1 * c1, 6)) AS score3, least(1.0::DOUBLE, round(0.5 * c4 + 0.3 * c3 + 0.15 * c2 + 0.05 * c1, 6)) AS score4
      FROM (SELECT regimen_id, coalesce(c4, 0)::DOUBLE AS c4, coalesce(c3, 0)::DOUBLE AS c3, coalesce(c2, 0)::DOUBLE AS c2, coalesce(c1, 0)::DOUBLE AS c1 FROM regimen_size LEFT JOIN p USING (regimen_id)))
    SELECT *, CASE WHEN score3 >= 0.6 THEN 'HIGH' WHEN score3 >= 0.3 THEN 'MODERATE' WHEN score3 > 0 THEN 'LOW' ELSE 'MINIMAL' END AS level3, CASE WHEN score4 >= 0.8 THEN 'CRITICAL' WHEN score4 >= 0.5 THEN 'HIGH' WHEN score4 >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS level4 FROM s""",
)
def h6(spark, sf):
    regs, _, found = base(spark, sf)
    return H.additive_scores(regs, found)


@query(
    "h7_index_summary",
    """, m AS (SELECT regimen_id, item, coalesce(pri, 0) AS pri, risk_level FROM regimens LEFT JOIN share_pri USING (item)), b AS (SELECT regimen_id, item, pri FROM (SELECT *, row_number() OVER (PARTITION BY regimen_id ORDER BY pri DESC, item) AS rn FROM m) WHERE rn = 1)
    SELECT regimen_id, round(sum(CAST(round(m.pri * 1000) AS BIGINT)) / 1000.0::DOUBLE / count(*), 6) AS average_pri, max(b.pri) AS max_pri, max(CASE WHEN b.pri > 0 THEN b.item END) AS highest, count(*) FILTER (risk_level = 'High Risk') AS high, count(*) FILTER (risk_level = 'Medium Risk') AS medium FROM m JOIN b USING (regimen_id) GROUP BY 1""",
)
def h7(spark, sf):
    return H.index_summary(V.regimens(spark, sf), N.share_metrics(cut_lineage(V.edges(spark, sf))))


# All valid substitutes of every item, scored by brute force.
SIMILAR_SQL = f""", {PREFIX_SQL}, pf AS (SELECT item, list(prefix) AS ps, list(plen) AS ls FROM prefixes WHERE plen >= 3 GROUP BY 1),
  lv AS (SELECT x.item AS target, y.item, max(CASE WHEN x.plen >= 5 THEN 5 ELSE x.plen END) AS level FROM prefixes x JOIN prefixes y ON x.prefix = y.prefix AND x.plen = y.plen AND x.item <> y.item WHERE x.plen >= 3 GROUP BY 1, 2),
  dz AS (SELECT x.item AS target, y.item, count(*) AS co FROM diseases x JOIN diseases y ON x.attr = y.attr AND x.item <> y.item GROUP BY 1, 2),
  pz AS (SELECT x.item AS target, y.item, count(*) AS co FROM proteins x JOIN proteins y ON x.attr = y.attr AND x.item <> y.item GROUP BY 1, 2),
  wz AS (SELECT x.item AS target, y.item, count(*) AS co FROM pathways x JOIN pathways y ON x.attr = y.attr AND x.item <> y.item GROUP BY 1, 2),
  nd AS (SELECT item, count(*) AS n FROM diseases GROUP BY 1), np AS (SELECT item, count(*) AS n FROM proteins GROUP BY 1), nw_ AS (SELECT item, count(*) AS n FROM pathways GROUP BY 1),
  sj AS (SELECT target, item, coalesce(level, 0) AS level, coalesce(dz.co, 0) AS dco, coalesce(pz.co, 0) AS pco, coalesce(wz.co, 0) AS wco FROM lv FULL JOIN dz USING (target, item) LEFT JOIN pz USING (target, item) LEFT JOIN wz USING (target, item)),
  sd AS (SELECT target, sj.item, level, CASE WHEN dco > 0 THEN dco / (d1.n + d2.n - dco)::DOUBLE ELSE 0 END AS dj, CASE WHEN pco > 0 THEN pco / (p1.n + p2.n - pco)::DOUBLE ELSE 0 END AS pj, CASE WHEN wco > 0 THEN wco / (w1.n + w2.n - wco)::DOUBLE ELSE 0 END AS wj
    FROM sj LEFT JOIN nd d1 ON d1.item = target LEFT JOIN nd d2 ON d2.item = sj.item LEFT JOIN np p1 ON p1.item = target LEFT JOIN np p2 ON p2.item = sj.item LEFT JOIN nw_ w1 ON w1.item = target LEFT JOIN nw_ w2 ON w2.item = sj.item),
  similar_all AS (SELECT target, item, level AS atc_level, dj AS disease_similarity, pj AS protein_similarity, wj AS pathway_similarity,
     round(0.50 * (CASE WHEN level >= 4 THEN 0.9::DOUBLE + (level - 4) * 0.05::DOUBLE WHEN level >= 3 THEN 0.7 ELSE level / 5.0 END) + 0.25 * dj + 0.15 * pj + 0.10 * wj, 6) AS therapeutic_score
     FROM sd WHERE level >= 5 OR (level >= 4 AND dj >= 0.25) OR (level >= 3 AND dj >= 0.35) OR dj >= 0.5),
  similar_ AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY therapeutic_score DESC, item) AS rank FROM similar_all)"""


def similar(spark, sf, targets=None, top_k=50):
    items = V.items(spark, sf)
    prefixes = codes.prefix_index(items, "item", "codes")
    wanted = items.select(F.col("item").alias("target")) if targets is None else targets
    return A.similar_items(wanted, cut_lineage(prefixes), cut_lineage(V.proteins(spark, sf)), cut_lineage(V.diseases(spark, sf)), cut_lineage(V.pathways(spark, sf)), top_k)


DECOMPOSE_SQL = SIMILAR_SQL + """, alt AS (SELECT target AS item, least(count(*), 10) AS n FROM similar_all GROUP BY 1),
  f AS (SELECT regimen_id, a, b, weight, label FROM regimen_edges),
  fe AS (SELECT regimen_id, p.a, p.b, count(*) AS shared_effects FROM regimen_pairs p JOIN side_effects x ON x.item = p.a JOIN side_effects y ON y.item = p.b AND y.attr = x.attr GROUP BY 1, 2, 3),
  fp AS (SELECT regimen_id, p.a, p.b, count(*) AS shared_proteins FROM regimen_pairs p JOIN proteins x ON x.item = p.a JOIN proteins y ON y.item = p.b AND y.attr = x.attr GROUP BY 1, 2, 3),
  dc AS (SELECT regimen_id, a, b, label, coalesce(weight, 0) AS weight, coalesce(shared_effects, 0) AS shared_effects, coalesce(shared_proteins, 0) AS shared_proteins FROM f FULL JOIN fe USING (regimen_id, a, b) FULL JOIN fp USING (regimen_id, a, b)),
  decomposed AS (SELECT *, round(100.0 * points / sum(points) OVER (PARTITION BY regimen_id), 8) AS share FROM (
    SELECT dc.*, round(0.6 * weight / 10 + 0.25 * least(shared_effects, 50) / 50.0::DOUBLE + 0.15 * least(shared_proteins, 10) / 10.0::DOUBLE, 9) AS points, CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) THEN a ELSE b END AS replace FROM dc LEFT JOIN alt x ON x.item = a LEFT JOIN alt y ON y.item = b))"""


def decomposed(spark, sf):
    regs, edges, _ = base(spark, sf)
    alternatives = similar(spark, sf, top_k=10).groupBy(F.col("target").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return H.decompose(regs, edges, V.side_effects(spark, sf), V.proteins(spark, sf), alternatives)


@query("h8_decomposition", DECOMPOSE_SQL + " SELECT regimen_id, a, b, weight, shared_effects, shared_proteins, share, replace FROM decomposed")
def h8(spark, sf):
    return decomposed(spark, sf).select("regimen_id", "a", "b", "weight", "shared_effects", "shared_proteins", "share", "replace")


ITEM_RISK_SQL = f""", ef AS (SELECT item, count(*) AS n_effects, count(*) FILTER ({any_contains('lower(attr)', rules.ITEM_RISK_EFFECTS)}) AS high_effects FROM side_effects GROUP BY 1),
  item_risk AS (SELECT item, degree AS n_interactions, wsum AS weight_sum, least(1.0::DOUBLE, wsum / 21000.0) AS ddi_risk, coalesce(n_effects, 0) AS n_effects, coalesce(high_effects, 0) AS high_effects,
   least(1.0::DOUBLE, (coalesce(n_effects, 0) + 5 * coalesce(high_effects, 0)) / 500.0::DOUBLE) AS effect_risk, weighted_degree AS centrality FROM metrics LEFT JOIN ef USING (item))"""


@query("h9_item_risk", ITEM_RISK_SQL + " SELECT item, n_interactions, weight_sum, n_effects, high_effects, round(0.5 * ddi_risk + 0.3 * effect_risk + 0.2 * centrality, 6) AS composite_risk FROM item_risk")
def h9(spark, sf):
    edges = cut_lineage(V.edges(spark, sf))
    risk = H.item_risk(edges, V.sampled_item_metrics(spark, sf), V.side_effects(spark, sf))
    return risk.select("item", "n_interactions", "weight_sum", "n_effects", "high_effects", F.round("composite_risk", 6).alias("composite_risk"))


MEMBER_SQL = f""", ms AS (SELECT regimen_id, item, count(*) AS k, count(*) FILTER (label IN {SEVERE_SQL}) AS severe FROM (SELECT regimen_id, a AS item, label FROM regimen_edges UNION ALL SELECT regimen_id, b, label FROM regimen_edges) GROUP BY 1, 2),
  member AS (SELECT regimen_id, item, coalesce(k, 0) AS interactions, coalesce(severe, 0) AS severe FROM regimens LEFT JOIN ms USING (regimen_id, item))"""


@query(
    "h10_highest_contributor",
    MEMBER_SQL + """, c AS (SELECT regimen_id, item, interactions, severe, round(0.4 * pri + 0.4 * severe / greatest(1, n - 1)::DOUBLE + 0.2 * weighted_degree, 9) AS contribution FROM member JOIN pri USING (item) JOIN regimen_size USING (regimen_id))
    SELECT regimen_id, item, round(contribution, 6) AS contribution, interactions, severe FROM (SELECT *, row_number() OVER (PARTITION BY regimen_id ORDER BY contribution DESC, item) AS rn FROM c) WHERE rn = 1""",
)
def h10(spark, sf):
    regs, edges, found = base(spark, sf)
    return H.highest_contributor(regs, found, V.sampled_item_metrics(spark, sf)).withColumn("contribution", F.round("contribution", 6))


@query("h12_size_escalation", f""", r AS (SELECT avg(CASE WHEN label IN {SEVERE_SQL} THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM edges), h AS (SELECT DISTINCT regimen_id FROM regimen_edges WHERE label IN {SEVERE_SQL}),
    o AS (SELECT n, count(*) AS regimens, count(h.regimen_id) AS hits FROM regimen_size s LEFT JOIN h USING (regimen_id) GROUP BY 1)
    SELECT g.n, round(1 - pow(1 - rate, g.n * (g.n - 1) / 2), 6) AS expected, coalesce(regimens, 0) AS regimens, round(hits / regimens::DOUBLE, 6) AS observed FROM (SELECT unnest(range(2, 11))::INTEGER AS n) g, r LEFT JOIN o ON o.n = g.n""")
def h12(spark, sf):
    return H.size_escalation(cut_lineage(V.edges(spark, sf)), V.regimens(spark, sf))


@query("h13_problem_items", f"SELECT regimen_id, unnest([a, b]) AS item FROM regimen_edges WHERE label IN {SEVERE_SQL} UNION SELECT regimen_id, item FROM regimens JOIN share_pri USING (item) WHERE pri > 0.5")
def h13(spark, sf):
    regs, edges, found = base(spark, sf)
    return H.problem_items(regs, found, N.share_metrics(edges))
