"""Risk of whole tables of regimens(regimen_id, item)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.functions import rules
from combirisk.functions.severity import scale_by_substring, scale_value
from combirisk.functions.text import any_of
from combirisk.session import cut_lineage
from combirisk.operators.pairs import overlap_edges, regimen_edges, regimen_overlaps, regimen_sizes, symmetric
from combirisk.operators.profiles import count_if
from combirisk.schemas import CONTRAINDICATED, MAJOR, MINOR, MODERATE, PAIR_WEIGHT_SCALE, SEVERE_LABELS, SHARE_SCALE


def label_counts(label: str = "label") -> list[Column]:
    c = F.col(label)
    return [
        count_if(c == CONTRAINDICATED).alias("contraindicated"),
        count_if(c == MAJOR).alias("major"),
        count_if(c == MODERATE).alias("moderate"),
        count_if(c == MINOR).alias("minor"),
    ]


def member_means(regimens: DataFrame, metrics: DataFrame, column: str = "pri") -> DataFrame:
    """(regimen_id, n_items, mean, top, top_item) over the members with a metric."""
    rows = regimens.select("regimen_id", "item").join(metrics.select("item", F.col(column).alias("v")), "item")
    best = F.min_by(F.struct("item", "v"), F.struct((-F.col("v")).alias("k"), "item")).alias("best")
    return rows.groupBy("regimen_id").agg(F.count(F.lit(1)).alias("n_items"), F.avg("v").alias("mean"), best).select(
        "regimen_id", "n_items", "mean", F.col("best.v").alias("top"), F.col("best.item").alias("top_item")
    )


@dataclass(frozen=True)
class NetworkWeights:
    """Points of the network score."""

    pri: float
    contraindicated: float
    major: float
    moderate: float
    phenotype: float
    interaction: float


# The two published weight records.
NETWORK_SCORE = NetworkWeights(30, 15, 8, 3, 5, 0)
DEMO_SCORE = NetworkWeights(30, 20, 10, 4, 0, 2)


def network_risk(regimens: DataFrame, found: DataFrame, metrics: DataFrame, weights: NetworkWeights = NETWORK_SCORE) -> DataFrame:
    """0-100 score and level of every regimen with at least one known member.

    ``found`` are the regimen edges with their phenotypes.  Phenotypes come from
    a fixed list, so each is one flag aggregated by ``max``; no sets are collected.
    """
    flags = [F.max(F.array_contains("phenotypes", p).cast("int")).alias(f"p_{p}") for p in rules.PHENOTYPES]
    per = found.groupBy("regimen_id").agg(F.count(F.lit(1)).alias("interactions"), *label_counts(), *flags)
    members = member_means(regimens, metrics)
    rows = members.join(per, "regimen_id", "left").fillna(0, [c for c in per.columns if c != "regimen_id"])
    phenotypes = reduce(lambda x, y: x + y, [F.col(f"p_{p}") for p in rules.PHENOTYPES])
    score = F.least(
        F.lit(100.0),
        weights.pri * F.col("mean")
        + weights.contraindicated * F.col("contraindicated")
        + weights.major * F.col("major")
        + weights.moderate * F.col("moderate")
        + weights.phenotype * phenotypes
        + weights.interaction * F.col("interactions"),
    )
    rows = rows.withColumn("score", score)
    s = F.col("score")
    level = (
        F.when((s >= 70) | (F.col("contraindicated") > 0), "CRITICAL")
        .when((s >= 50) | (F.col("major") >= 2), "HIGH")
        .when(s >= 25, "MODERATE")
        .otherwise("LOW")
    )
    return rows.select(
        "regimen_id", "n_items", "interactions", "contraindicated", "major", "moderate", "minor",
        phenotypes.alias("phenotypes"), "mean", "top", "top_item", F.round("score", 2).alias("risk_score"), level.alias("risk_level"),
    )


def pair_count(n: Column) -> Column:
    return n * (n - 1) / 2


def _interaction_share(weight: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(weight, 10.0 * pair_count(n)), F.lit(0.0))


def _pair_share(pairs: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(pairs, pair_count(n)), F.lit(0.0))


def _effect_share(pairs: Column, high: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * _pair_share(pairs, n) + 0.5 * F.least(F.lit(1.0), high / (2.0 * n)))


def _high_hits(terms, cap: int) -> Column:
    return F.least(F.sum(F.when(any_of(F.lower("attr"), terms), 1).otherwise(0)), F.lit(cap))


def interaction_part(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Severity sum over ten points per possible pair."""
    per = found.groupBy("regimen_id").agg(F.sum("weight").alias("w"))
    return sizes.join(per, "regimen_id", "left").select("regimen_id", _interaction_share(F.col("w"), F.col("n")).alias("ddi_risk"))


def effect_part(regimens: DataFrame, effects: DataFrame, sizes: DataFrame, terms=rules.HIGH_RISK_EFFECTS, cap: int = 5) -> DataFrame:
    """Half the share of overlapping pairs, half the high-risk hits (at most ``cap`` per pair) over 2n."""
    per_pair = regimen_overlaps(regimens, effects, _high_hits(terms, cap).alias("high"))
    per = per_pair.groupBy("regimen_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("high").alias("high"), count_if(F.col("high") > 0).alias("high_pairs")
    )
    rows = sizes.join(per, "regimen_id", "left").fillna(0, ["pairs", "high", "high_pairs"])
    return rows.select("regimen_id", _effect_share(F.col("pairs"), F.col("high"), F.col("n")).alias("effect_risk"), "high_pairs")


def overlap_part(regimens: DataFrame, attributes: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Share of the possible pairs that overlap, with their number."""
    per = regimen_overlaps(regimens, attributes, F.count(F.lit(1)).alias("shared")).groupBy("regimen_id").agg(F.count(F.lit(1)).alias("pairs"))
    rows = sizes.join(per, "regimen_id", "left").fillna(0, ["pairs"])
    return rows.select("regimen_id", _pair_share(F.col("pairs"), F.col("n")).alias(f"{name}_risk"), F.col("pairs").alias(f"{name}_pairs"))


def network_part(regimens: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean weighted degree of all members, items outside the network counting 0."""
    rows = regimens.select("regimen_id", "item").join(metrics.select("item", "weighted_degree"), "item", "left")
    return rows.groupBy("regimen_id").agg(F.avg(F.coalesce("weighted_degree", F.lit(0.0))).alias("network_risk"))


# Part weights and level cuts of the five-part score.
PART_WEIGHTS = {"ddi_risk": 0.40, "effect_risk": 0.25, "protein_risk": 0.15, "pathway_risk": 0.10, "network_risk": 0.10}
LEVELS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MODERATE"), (0.2, "LOW")]


def five_part_risk(
    regimens: DataFrame,
    edges: DataFrame,
    metrics: DataFrame,
    effects: DataFrame,
    proteins: DataFrame,
    pathways: DataFrame,
) -> DataFrame:
    """Five parts, their weighted sum and the level of every regimen.

    What a pair contributes is put together once for each distinct pair, and all
    parts but the network's are one aggregate over the pairs of a regimen.
    Regimens below two items are MINIMAL, 0.
    """
    one = F.count(F.lit(1))
    per_pair = (
        edges.select("a", "b", "weight", "label")
        .join(overlap_edges(regimens, effects, _high_hits(rules.HIGH_RISK_EFFECTS, 5).alias("high")), ["a", "b"], "full")
        .join(overlap_edges(regimens, proteins, one.alias("proteins")), ["a", "b"], "full")
        .join(overlap_edges(regimens, pathways, one.alias("pathways")), ["a", "b"], "full")
    )
    per = regimen_edges(regimens, cut_lineage(per_pair)).groupBy("regimen_id").agg(
        F.sum("weight").alias("weight"), F.count("high").alias("pairs"), F.sum("high").alias("high"), count_if(F.col("high") > 0).alias("high_pairs"),
        F.count("proteins").alias("protein_pairs"), F.count("pathways").alias("pathway_pairs"), *label_counts(),
    )
    counts = ["pairs", "high", "high_pairs", "protein_pairs", "pathway_pairs", "contraindicated", "major", "moderate", "minor"]
    n = F.col("n")
    rows = (
        regimen_sizes(regimens).join(per, "regimen_id", "left").fillna(0, counts)
        .withColumns({
            "ddi_risk": _interaction_share(F.col("weight"), n),
            "effect_risk": _effect_share(F.col("pairs"), F.col("high"), n),
            "protein_risk": _pair_share(F.col("protein_pairs"), n),
            "pathway_risk": _pair_share(F.col("pathway_pairs"), n),
        })
        .drop("weight", "pairs", "high")
        .join(network_part(regimens, metrics), "regimen_id")
    )
    total = reduce(lambda x, y: x + y, [w * F.col(c) for c, w in PART_WEIGHTS.items()])
    scored = rows.withColumn("overall", F.when(F.col("n") >= 2, F.round(total, 9)).otherwise(0.0))
    level = F.lit("MINIMAL")
    for cut, name in reversed(LEVELS):
        level = F.when(F.col("overall") >= cut, name).otherwise(level)
    return scored.withColumn("risk_level", level)


def messages(risk: DataFrame) -> DataFrame:
    """Recommendation lines per regimen from its counts and level."""
    say = lambda condition, text: F.when(condition, text)
    level, n = F.col("risk_level"), F.format_string
    lines = F.array_compact(
        F.array(
            say(level == "CRITICAL", F.lit("CRITICAL RISK: Immediate review recommended.")),
            say(level == "HIGH", F.lit("HIGH RISK: Close monitoring required.")),
            say(F.col("contraindicated") > 0, n("%d CONTRAINDICATED interaction(s) detected.", F.col("contraindicated"))),
            say(F.col("major") > 0, n("%d MAJOR interaction(s) require monitoring.", F.col("major"))),
            say(F.col("high_pairs") > 0, n("%d drug pair(s) share serious side effect risks.", F.col("high_pairs"))),
            say(F.col("protein_pairs") > 0, n("%d drug pair(s) share protein targets.", F.col("protein_pairs"))),
        )
    )
    none = F.array(F.lit("No critical risks identified. Continue routine monitoring."))
    few = F.array(F.lit("Need at least 2 drugs for polypharmacy risk."))
    return risk.withColumn("messages", F.when(F.col("n") < 2, few).when(F.size(lines) == 0, none).otherwise(lines))


def severity_score(regimens: DataFrame, found: DataFrame) -> DataFrame:
    """Weight sum over ten points per found interaction, and the level with the worst label."""
    per = found.groupBy("regimen_id").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("k"), F.max("numeric").alias("worst"))
    rows = regimen_sizes(regimens).join(per, "regimen_id", "left")
    score = F.when(F.col("k") > 0, F.least(F.lit(100.0), F.col("w") / (10.0 * F.col("k")) * 100)).otherwise(0.0)
    scored = rows.withColumn("score", score)
    s, worst = F.col("score"), F.col("worst")
    level = (
        F.when(F.col("k").isNull(), "NO_RISK").when((s >= 70) | (worst == 4), "CRITICAL").when((s >= 50) | (worst == 3), "HIGH").when(s >= 25, "MODERATE").otherwise("LOW")
    )
    return scored.select("regimen_id", "n", F.coalesce("k", F.lit(0)).alias("interactions"), F.round("score", 2).alias("score"), "worst", level.alias("risk_level"))


def mean_share_score(regimens: DataFrame, found: DataFrame) -> DataFrame:
    """Mean label share over the found interactions, with level counts."""
    share = F.round(scale_by_substring("label", SHARE_SCALE) * 100).cast("long")
    per = found.withColumn("h", share).groupBy("regimen_id").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("k"), *label_counts())
    rows = regimen_sizes(regimens).join(per, "regimen_id", "left").fillna(0)
    score = F.when(F.col("k") > 0, F.least(F.col("h") / 100.0 / F.col("k"), F.lit(1.0))).otherwise(0.0)
    return rows.select("regimen_id", F.round(score, 6).alias("score"), "contraindicated", "major", "moderate", "minor")


def confidence_weighted(regimens: DataFrame, interactions: DataFrame) -> DataFrame:
    """Sum of label weight times confidence over every matching row of every pair."""
    keyed = interactions.select(
        F.least("drug_name_1", "drug_name_2").alias("a"), F.greatest("drug_name_1", "drug_name_2").alias("b"),
        # Confidences have two decimals: whole hundredths add up exactly.
        (scale_value("severity_label", PAIR_WEIGHT_SCALE) * F.round(F.col("severity_confidence") * 100)).cast("long").alias("points"),
    )
    # Summed per pair before it meets the regimens: the join stays one row per pair.
    per_pair = keyed.groupBy("a", "b").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("rows"))
    found = regimen_edges(regimens, per_pair)
    per = found.groupBy("regimen_id").agg((F.sum("points") / 100.0).alias("score"), F.sum("rows").alias("rows"))
    return regimen_sizes(regimens).select("regimen_id").join(per, "regimen_id", "left").fillna(0, ["score", "rows"])


def additive_scores(regimens: DataFrame, found: DataFrame) -> DataFrame:
    """Two capped additive scores with their levels."""
    per = found.groupBy("regimen_id").agg(*label_counts())
    rows = regimen_sizes(regimens).join(per, "regimen_id", "left").fillna(0)
    c, m, o, i = (F.col(x) for x in ("contraindicated", "major", "moderate", "minor"))
    short = F.least(F.lit(1.0), F.round(0.4 * (c + m) + 0.2 * o + 0.1 * i, 6))
    long = F.least(F.lit(1.0), F.round(0.5 * c + 0.3 * m + 0.15 * o + 0.05 * i, 6))
    scored = rows.select("regimen_id", short.alias("score3"), long.alias("score4"))
    level3 = F.when(F.col("score3") >= 0.6, "HIGH").when(F.col("score3") >= 0.3, "MODERATE").when(F.col("score3") > 0, "LOW").otherwise("MINIMAL")
    level4 = F.when(F.col("score4") >= 0.8, "CRITICAL").when(F.col("score4") >= 0.5, "HIGH").when(F.col("score4") >= 0.2, "MODERATE").otherwise("LOW")
    return scored.select("*", level3.alias("level3"), level4.alias("level4"))


def index_summary(regimens: DataFrame, index: DataFrame) -> DataFrame:
    """Mean, maximum and its item, counts by level; items outside the network count 0."""
    rows = regimens.select("regimen_id", "item").join(index.select("item", "pri", "risk_level"), "item", "left").fillna(0.0, ["pri"])
    best = F.min_by(F.struct("item", "pri"), F.struct((-F.col("pri")).alias("k"), "item")).alias("best")
    return rows.groupBy("regimen_id").agg(
        F.round(F.sum(F.round(F.col("pri") * 1000).cast("long")) / 1000.0 / F.count(F.lit(1)), 6).alias("average_pri"),
        best,
        count_if(F.col("risk_level") == "High Risk").alias("high"),
        count_if(F.col("risk_level") == "Medium Risk").alias("medium"),
    ).select("regimen_id", "average_pri", F.col("best.pri").alias("max_pri"), F.when(F.col("best.pri") > 0, F.col("best.item")).alias("highest"), "high", "medium")


def decompose(
    regimens: DataFrame, edges: DataFrame, effects: DataFrame, proteins: DataFrame, alternatives: DataFrame
) -> DataFrame:
    """Contribution of every pair of a regimen, in points and as share of the regimen.

    Pairs that neither interact nor share anything contribute nothing and are
    left out.  ``alternatives(item, n)`` decides which side to replace: the one
    with more substitutes, the first on a tie.
    """
    count = lambda attrs, name: overlap_edges(regimens, attrs, F.count(F.lit(1)).alias(name))
    per_pair = (
        edges.select("a", "b", "weight", "label")
        .join(count(effects, "shared_effects"), ["a", "b"], "full")
        .join(count(proteins, "shared_proteins"), ["a", "b"], "full")
        .fillna(0, ["shared_effects", "shared_proteins"])
        .fillna(0.0, ["weight"])
    )
    rows = regimen_edges(regimens, cut_lineage(per_pair))
    points = (
        0.6 * F.col("weight") / 10.0
        + 0.25 * F.least("shared_effects", F.lit(50)) / 50.0
        + 0.15 * F.least("shared_proteins", F.lit(10)) / 10.0
    )
    w = Window.partitionBy("regimen_id")
    one = alternatives.select(F.col("item").alias("a"), F.col("n").alias("n1"))
    two = alternatives.select(F.col("item").alias("b"), F.col("n").alias("n2"))
    return (
        rows.withColumn("points", F.round(points, 9))
        .withColumn("share", F.round(100.0 * F.col("points") / F.sum("points").over(w), 8))
        .join(one, "a", "left")
        .join(two, "b", "left")
        .fillna(0, ["n1", "n2"])
        .withColumn("replace", F.when(F.col("n1") >= F.col("n2"), F.col("a")).otherwise(F.col("b")))
    )


def item_risk(edges: DataFrame, metrics: DataFrame, effects: DataFrame, max_pairs: float = 3000.0, max_effects: float = 500.0) -> DataFrame:
    """Item score: .5 interactions + .3 side effects + .2 centrality, each capped at 1."""
    high = any_of(F.lower("attr"), rules.ITEM_RISK_EFFECTS)
    per = effects.groupBy("item").agg(F.count(F.lit(1)).alias("n_effects"), count_if(high).alias("high_effects"))
    rows = metrics.join(per, "item", "left").fillna(0, ["n_effects", "high_effects"])
    ddi = F.least(F.lit(1.0), F.col("weight_sum") / (max_pairs * 7))
    effect = F.least(F.lit(1.0), (F.col("n_effects") + 5 * F.col("high_effects")) / max_effects)
    return rows.select(
        "item", F.col("degree").alias("n_interactions"), "weight_sum", ddi.alias("ddi_risk"), "n_effects", "high_effects",
        effect.alias("effect_risk"), F.col("weighted_degree").alias("centrality"),
        (0.5 * ddi + 0.3 * effect + 0.2 * F.col("weighted_degree")).alias("composite_risk"),
    )


def member_severity(regimens: DataFrame, found: DataFrame) -> DataFrame:
    """(regimen_id, item, interactions, severe): each member's interactions inside its regimen."""
    both = symmetric(found.select("regimen_id", "a", "b", "label")).groupBy("regimen_id", "item").agg(
        F.count(F.lit(1)).alias("interactions"), count_if(F.col("label").isin(SEVERE_LABELS)).alias("severe")
    )
    return regimens.select("regimen_id", "item").join(both, ["regimen_id", "item"], "left").fillna(0, ["interactions", "severe"])


def highest_contributor(regimens: DataFrame, found: DataFrame, metrics: DataFrame) -> DataFrame:
    """Member with the largest .4 index + .4 severe share + .2 weighted degree."""
    rows = (
        member_severity(regimens, found)
        .join(metrics.select("item", "pri", "weighted_degree"), "item")
        .join(regimen_sizes(regimens), "regimen_id")
    )
    score = 0.4 * F.col("pri") + 0.4 * F.col("severe") / F.greatest(F.lit(1), F.col("n") - 1) + 0.2 * F.col("weighted_degree")
    scored = rows.withColumn("contribution", F.round(score, 9))
    best = F.min_by(F.struct("item", "contribution", "interactions", "severe"), F.struct((-F.col("contribution")).alias("k"), "item")).alias("b")
    return scored.groupBy("regimen_id").agg(best).select("regimen_id", "b.*")


def problem_items(regimens: DataFrame, found: DataFrame, index: DataFrame, cut: float = 0.5) -> DataFrame:
    """Distinct (regimen_id, item): ends of severe pairs, and members above the index cut."""
    severe = found.filter(F.col("label").isin(SEVERE_LABELS)).select("regimen_id", F.explode(F.array("a", "b")).alias("item"))
    risky = regimens.select("regimen_id", "item").join(index.filter(F.col("pri") > cut).select("item"), "item", "left_semi")
    return severe.unionByName(risky.select("regimen_id", "item")).distinct()


def size_escalation(edges: DataFrame, regimens: DataFrame, top: int = 10) -> DataFrame:
    """Expected and observed chance of at least one severe pair by regimen size."""
    rate = edges.agg(F.avg(F.col("label").isin(SEVERE_LABELS).cast("double"))).scalar()
    grid = edges.sparkSession.range(2, top + 1).select(F.col("id").cast("int").alias("n"))
    expected = grid.withColumn("rate", rate).select("n", (1 - F.pow(1 - F.col("rate"), pair_count(F.col("n")))).alias("expected"))
    severe = regimen_edges(regimens, edges.filter(F.col("label").isin(SEVERE_LABELS))).select("regimen_id").distinct()
    observed = (
        regimen_sizes(regimens).join(severe.withColumn("hit", F.lit(1)), "regimen_id", "left")
        .groupBy(F.col("n").cast("int").alias("n")).agg(F.count(F.lit(1)).alias("regimens"), F.count("hit").alias("hits"))
    )
    return expected.join(observed, "n", "left").select(
        "n", F.round("expected", 6).alias("expected"), F.coalesce("regimens", F.lit(0)).alias("regimens"), F.round(F.try_divide("hits", "regimens"), 6).alias("observed")
    )


