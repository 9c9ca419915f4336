"""Interaction network: nodes, metrics, composite indices, sub-networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.functions.severity import label_rank, scale_by_substring
from combirisk.operators.pairs import symmetric
from combirisk.operators.profiles import count_if
from combirisk.operators.quantiles import quantile_values
from combirisk.operators.statistics import global_rank, hash_number
from combirisk.session import cut_lineage, scalar_row
from combirisk.schemas import CONTRAINDICATED, MAJOR, MINOR, MODERATE, SEVERE_LABELS, SHARE_SCALE

# Index weights.
PRI_WEIGHTS = {"degree": 0.25, "weighted_degree": 0.30, "betweenness": 0.20, "severity_profile": 0.25}
CENTRALITY_WEIGHTS = {"degree_centrality": 0.30, "betweenness": 0.25, "eigenvector": 0.20, "pagerank": 0.15, "closeness": 0.10}


def node_table(interactions: DataFrame) -> DataFrame:
    """Distinct items; side 1 before side 2, later rows (by code text) before earlier ones."""
    side = lambda n: F.struct(
        F.col(f"drug_name_{n}").alias("item"),
        F.lit(-n).alias("side"),
        F.col(f"drugbank_id_{n}").alias("drug_id"),
        F.col(f"atc_{n}").alias("atc"),
        F.col(f"is_cardiovascular_{n}").alias("is_cardiovascular"),
        F.col(f"is_antithrombotic_{n}").alias("is_antithrombotic"),
    )
    rows = interactions.select(F.explode(F.array(side(1), side(2))).alias("s")).select("s.*")
    best = F.max(F.struct("side", "drug_id", "atc", "is_cardiovascular", "is_antithrombotic")).alias("best")
    first_code = F.regexp_extract("best.atc", "'([^']+)'", 1)
    return rows.groupBy("item").agg(best).select(
        "item", "best.drug_id", "best.atc", "best.is_cardiovascular", "best.is_antithrombotic",
        F.when(first_code != "", F.substring(first_code, 1, 4)).alias("level_3"),
        F.when(first_code != "", F.substring(first_code, 1, 5)).alias("level_4"),
    )


def degree_table(edges: DataFrame) -> DataFrame:
    """Per item: degree, weight sum and counts per severity, one aggregation over both ends."""
    c = F.col("label")
    return symmetric(edges.select("a", "b", "label", "weight")).groupBy("item").agg(
        F.count(F.lit(1)).alias("degree"),
        F.sum("weight").alias("weight_sum"),
        count_if(c == CONTRAINDICATED).alias("contraindicated"),
        count_if(c == MAJOR).alias("major"),
        count_if(c == MODERATE).alias("moderate"),
        count_if(c == MINOR).alias("minor"),
    )


def severity_profile() -> Column:
    total = F.col("contraindicated") + F.col("major") + F.col("moderate") + F.col("minor")
    score = 10 * F.col("contraindicated") + 7 * F.col("major") + 4 * F.col("moderate") + F.col("minor")
    return F.least(F.lit(1.0), score / (10.0 * F.greatest(F.lit(1), total)))


def node_metrics(edges: DataFrame, betweenness: DataFrame) -> DataFrame:
    """Centralities, severity profile and the composite index of every item.

    ``betweenness(item, betweenness)`` comes from the traversal kernel.
    """
    degrees = degree_table(edges)
    bounds = scalar_row(degrees, n=F.count(F.lit(1)), w=F.max("weight_sum"))
    n, top_weight = bounds["n"], bounds["w"]
    metrics = degrees.select(
        "*",
        (F.col("degree") / F.greatest(n - 1, F.lit(1))).alias("degree_centrality"),
        (F.col("weight_sum") / top_weight).alias("weighted_degree"),
        severity_profile().alias("severity_profile"),
    )
    metrics = metrics.join(betweenness.select("item", "betweenness"), "item", "left")
    # Unlike ``fillna``, this leaves an undefined share (NaN) as it is.
    metrics = metrics.withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    w = PRI_WEIGHTS
    pri = (
        w["degree"] * F.col("degree_centrality")
        + w["weighted_degree"] * F.col("weighted_degree")
        + w["betweenness"] * F.col("betweenness")
        + w["severity_profile"] * F.col("severity_profile")
    )
    return metrics.withColumn("pri", pri)


def share_metrics(edges: DataFrame) -> DataFrame:
    """Light index: maxima-normalised degree and weight, severe share, degree proxy."""
    weight = scale_by_substring("label", SHARE_SCALE)
    # Weights have two decimals: sums of hundredths are exact.
    hundredths = F.round(weight * 100).cast("long")
    rows = symmetric(edges.select("a", "b", hundredths.alias("h")))
    degrees = rows.groupBy("item").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("h").alias("h"), count_if(F.col("h") >= 70).alias("severe")
    )
    bounds = scalar_row(degrees, d=F.max("degree"), h=F.max("h"))
    d, h = bounds["d"], bounds["h"]
    pri = F.round(
        0.25 * F.col("degree") / d + 0.30 * F.col("h") / h + 0.20 * F.col("degree") / d + 0.25 * F.col("severe") / F.col("degree"), 3
    )
    scored = degrees.withColumn("pri", pri)
    level = F.when(F.col("pri") > 0.5, "High Risk").when(F.col("pri") >= 0.3, "Medium Risk").otherwise("Lower Risk")
    return scored.select("item", "degree", (F.col("h") / 100.0).alias("weight_share"), "severe", "pri", level.alias("risk_level"))


def composite_risk(metrics: DataFrame) -> DataFrame:
    """.4 weighted / max + .3 degree / max + .3 betweenness / max."""
    bounds = scalar_row(metrics, w=F.max("weight_sum"), d=F.max("degree_centrality"), b=F.max("betweenness"))
    w, d, b = bounds["w"], bounds["d"], bounds["b"]
    score = 0.4 * F.col("weight_sum") / w + 0.3 * F.col("degree_centrality") / d + 0.3 * F.col("betweenness") / F.nullif(b, F.lit(0.0))
    return metrics.withColumn("risk_score", score)


def density_statistics(edges: DataFrame) -> DataFrame:
    """n, m, density and degree moments in one row."""
    degrees = cut_lineage(symmetric(edges.select("a", "b")).groupBy("item").agg(F.count(F.lit(1)).alias("degree")))
    (median,) = quantile_values(degrees, "degree", [0.5])
    n, m = F.count(F.lit(1)), F.sum("degree") / 2
    return degrees.agg(
        n.alias("n"),
        m.cast("long").alias("m"),
        F.round(2 * m / (n * (n - 1.0)), 8).alias("density"),
        F.round(F.avg("degree"), 6).alias("mean_degree"),
        F.round(F.lit(median).cast("double"), 6).alias("median_degree"),
        F.round(F.stddev_pop("degree"), 6).alias("sd_degree"),
        F.max("degree").alias("max_degree"),
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """Every edge once, from its end of lower degree (ties by name) to the other.

    A hub then has few outgoing edges, so the wedges of the triangle join stay
    near m^1.5 at worst even when one item touches a third of all edges.
    """
    degrees = symmetric(edges.select("a", "b")).groupBy("item").agg(F.count(F.lit(1)).alias("d"))
    sized = (
        edges.select("a", "b")
        .join(degrees.select(F.col("item").alias("a"), F.col("d").alias("da")), "a")
        .join(degrees.select(F.col("item").alias("b"), F.col("d").alias("db")), "b")
    )
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def clustering(edges: DataFrame) -> DataFrame:
    """(item, degree, triangles, clustering) of every item."""
    out = _oriented(edges)
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").filter(F.col("v") < F.col("w"))
    closed = wedges.join(edges.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"], "left_semi")
    triangles = closed.select(F.explode(F.array("u", "v", "w")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("triangles"))
    degrees = symmetric(edges.select("a", "b")).groupBy("item").agg(F.count(F.lit(1)).alias("degree"))
    share = F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))
    return degrees.join(triangles, "item", "left").fillna(0, ["triangles"]).withColumn("clustering", share)


def robustness(edges: DataFrame, ranks: DataFrame, steps: int = 20, top_share: float = 0.3) -> DataFrame:
    """ranks(item, strategy, rank): mean remaining degree per removal step, relative to step 0.

    An edge is gone at a step as soon as its better-ranked end is removed, so
    each edge contributes to a prefix of the steps: one pass, no per-step join.
    """
    n = ranks.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    one = ranks.select("strategy", F.col("item").alias("a"), F.col("rank").alias("ra"))
    two = ranks.select("strategy", F.col("item").alias("b"), F.col("rank").alias("rb"))
    first_gone = edges.select("a", "b").join(one, "a").join(two, ["strategy", "b"]).groupBy(
        "strategy", F.least("ra", "rb").alias("at")
    ).agg(F.count(F.lit(1)).alias("m"))
    step = n.select("strategy", "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn(
        "removed", F.floor(F.round(F.col("n") * F.lit(top_share) * F.col("step") / (steps - 1), 9))
    )
    # At most ``steps`` rows per strategy meet the per-rank counts.
    alive = (
        first_gone.join(F.broadcast(step), "strategy").filter(F.col("at") > F.col("removed")).groupBy("strategy", "step").agg(F.sum("m").alias("m"))
    )
    degree = step.join(alive, ["strategy", "step"], "left").withColumn("degree", 2.0 * F.coalesce("m", F.lit(0)) / (F.col("n") - F.col("removed")))
    base = degree.filter("step = 0").select("strategy", F.col("degree").alias("base"))
    return degree.join(base, "strategy").select("strategy", "step", "removed", F.round(F.try_divide("degree", "base"), 6).alias("connectivity"))


def removal_ranks(metrics: DataFrame, seed: int = 42) -> DataFrame:
    """(item, strategy, rank) by index, by degree and by seeded hash."""
    by = lambda df, col, name: global_rank(df, col, "item").select("item", F.lit(name).alias("strategy"), "rank")
    rounded = metrics.select("item", F.round("pri", 9).alias("pri"), "degree", hash_number(F.lit(seed), F.col("item")).alias("draw"))
    rounded = cut_lineage(rounded)
    return (
        by(rounded.select("item", "pri"), "pri", "pri")
        .unionByName(by(rounded.select("item", "degree"), "degree", "degree"))
        .unionByName(by(rounded.select("item", "draw"), "draw", "random"))
    )


def degree_distribution(edges: DataFrame) -> DataFrame:
    return (
        symmetric(edges.select("a", "b")).groupBy("item").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    )


def power_slope(distribution: DataFrame) -> DataFrame:
    """Slope and intercept of log10(n) on log10(degree)."""
    x, y = F.log10("degree"), F.log10("n")
    return distribution.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.count(F.lit(1)).alias("points"))


def induced(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges between the given items."""
    keep = items.select("item").distinct()
    return edges.join(keep.withColumnRenamed("item", "a"), "a", "left_semi").join(keep.withColumnRenamed("item", "b"), "b", "left_semi")


def top_items(metrics: DataFrame, k: int, by: str) -> DataFrame:
    return metrics.orderBy(F.desc(by), F.asc("item")).limit(k).select("item")


def severe_network(edges: DataFrame, k: int = 30) -> DataFrame:
    """Severe edges among the k items with most of them."""
    severe = edges.filter(F.col("label").isin(SEVERE_LABELS))
    counts = symmetric(severe.select("a", "b")).groupBy("item").agg(F.count(F.lit(1)).alias("severe"))
    return induced(severe, top_items(counts, k, "severe"))


def ego_networks(edges: DataFrame, centres: DataFrame, k: int = 60) -> DataFrame:
    """(centre, a, b, label, role): the k most severe neighbours of each centre and the edges among them."""
    both = symmetric(edges.select("a", "b", "label", "weight"))
    near = both.join(centres.select(F.col("centre").alias("item")).distinct(), "item").withColumnRenamed("item", "centre")
    w = Window.partitionBy("centre").orderBy(F.desc("weight"), label_rank(F.col("label")), "other")
    kept = near.withColumn("rank_", F.row_number().over(w)).filter(F.col("rank_") <= k).select("centre", "other", "label")
    spokes = kept.select("centre", F.least("centre", "other").alias("a"), F.greatest("centre", "other").alias("b"), "label", F.lit("spoke").alias("role"))
    # Each centre has at most k neighbours, so looking up their edges is bounded.
    member = kept.select("centre", F.col("other").alias("a"))
    rim = (
        member.join(edges.select("a", "b", "label"), "a")
        .join(kept.select("centre", F.col("other").alias("b")), ["centre", "b"], "left_semi")
        .select("centre", "a", "b", "label", F.lit("rim").alias("role"))
    )
    return spokes.unionByName(rim)


def property_graph(parts: dict[str, DataFrame], links: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Typed nodes(id, kind, props) and edges(src, dst, kind, props).

    ``parts[kind]`` has ``id`` and property columns, ``links[kind]`` has
    ``src``, ``dst`` and property columns; repeated ids and edges collapse.
    """
    def props(df: DataFrame, skip: set[str]) -> Column:
        names = [c for c in df.columns if c not in skip]
        if not names:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names])), lambda k, v: v.isNotNull())

    nodes = edges = None
    for kind, df in parts.items():
        part = df.dropDuplicates(["id"]).select("id", F.lit(kind).alias("kind"), props(df, {"id"}).alias("props"))
        nodes = part if nodes is None else nodes.unionByName(part)
    for kind, df in links.items():
        part = df.dropDuplicates(["src", "dst"]).select("src", "dst", F.lit(kind).alias("kind"), props(df, {"src", "dst"}).alias("props"))
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges


def interaction_subgraph(edges: DataFrame, kind: str = "ddi") -> DataFrame:
    """Interaction edges of a property graph as (a, b); items without any are absent."""
    return edges.filter(F.col("kind") == kind).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
