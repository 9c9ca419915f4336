"""Iterated joins over the network: PageRank, eigenvector, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combirisk.operators.pairs import symmetric
from combirisk.session import cut_lineage

# Rounds planned together before the lineage is cut.
ROUNDS_PER_CUT = 3


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(item, pagerank) on the undirected network; stops when the L1 change is below n * tolerance."""
    links = symmetric(edges.select("a", "b"))
    degrees = links.groupBy("item").agg(F.count(F.lit(1)).alias("degree"))
    graph = cut_lineage(links.join(degrees, "item").select("item", "other", "degree"))
    n = degrees.count()
    ranks = cut_lineage(degrees.select("item", F.lit(1.0 / n).alias("pagerank")))
    for i in range(1, rounds + 1):
        spread = graph.join(ranks, "item").groupBy(F.col("other").alias("item")).agg(F.sum(F.col("pagerank") / F.col("degree")).alias("s"))
        new = spread.select("item", (F.lit((1 - damping) / n) + damping * F.col("s")).alias("pagerank"))
        if i % ROUNDS_PER_CUT == 0 or i == rounds:
            new = cut_lineage(new)
            if tolerance is not None:
                change = new.join(ranks.withColumnRenamed("pagerank", "old"), "item").agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
                if change is None or change < n * tolerance:
                    return new
        ranks = new
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float | None = 1e-6) -> DataFrame:
    """(item, eigenvector): power iteration on A + I, unit Euclidean length after every round."""
    graph = cut_lineage(symmetric(edges.select("a", "b")))
    items = graph.select("item").distinct()
    n = items.count()
    vector = cut_lineage(items.select("item", F.lit(1.0 / n).alias("x")))
    for i in range(1, rounds + 1):
        pulled = graph.join(vector, "item").groupBy(F.col("other").alias("item")).agg(F.sum("x").alias("s"))
        raw = pulled.join(vector, "item").select("item", (F.col("s") + F.col("x")).alias("x"))
        norm = F.sqrt(raw.agg(F.sum(F.col("x") * F.col("x"))).scalar())
        new = raw.select("item", (F.col("x") / norm).alias("x"))
        # The norm reads the round twice, so every round is cut.
        new = cut_lineage(new)
        if tolerance is not None:
            change = new.join(vector.withColumnRenamed("x", "old"), "item").agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
            if change is None or change < n * tolerance:
                return new.withColumnRenamed("x", "eigenvector")
        vector = new
    return vector.withColumnRenamed("x", "eigenvector")


def components(edges: DataFrame) -> DataFrame:
    """(item, component): smallest item name of each connected component."""
    graph = cut_lineage(symmetric(edges.select("a", "b")))
    labels = cut_lineage(graph.groupBy("item").agg(F.least(F.first("item"), F.min("other")).alias("component")))
    while True:
        pulled = graph.join(labels.select(F.col("item").alias("other"), "component"), "other").groupBy("item").agg(F.min("component").alias("near"))
        # Jump: also take the label of the current label's own component.
        jump = labels.select(F.col("item").alias("component"), F.col("component").alias("far"))
        new = cut_lineage(
            labels.join(pulled, "item").join(jump, "component", "left").select("item", F.col("component").alias("old"), F.least("component", "near", "far").alias("component"))
        )
        if new.filter("component <> old").isEmpty():
            return new.select("item", "component")
        labels = new.select("item", "component")


def _local_moves(graph: DataFrame, two_m: float, rounds: int) -> DataFrame:
    """(item, community) after parallel local moves on graph(item, other, w).

    Half of the items, by hash, may move in a round, so neighbours do not swap
    forever; the move with the largest modularity gain wins, ties to the
    smallest community name, and only real gains are taken.
    """
    strength = cut_lineage(graph.groupBy("item").agg(F.sum("w").alias("k")))
    labels = strength.select("item", F.col("item").alias("community"), "k")
    links = graph.filter("item <> other")
    for i in range(rounds):
        totals = labels.groupBy("community").agg(F.sum("k").alias("tot"))
        near = (
            links.join(labels.select(F.col("item").alias("other"), "community"), "other")
            .groupBy("item", "community")
            .agg(F.sum("w").alias("w"))
        )
        own = labels.select("item", "community", F.lit(0.0).alias("w"))
        gains = (
            near.unionByName(own).groupBy("item", "community").agg(F.sum("w").alias("w"))
            .join(totals, "community")
            .join(labels.select("item", F.col("community").alias("mine"), "k"), "item")
            .withColumn("rest", F.col("tot") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0.0))
            .withColumn("gain", F.round(F.col("w") - F.col("k") * F.col("rest") / two_m, 9))
        )
        best = gains.groupBy("item", "mine", "k").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "community")).alias("b"),
            F.max(F.when(F.col("community") == F.col("mine"), F.col("gain"))).alias("stay"),
        )
        may_move = F.pmod(F.xxhash64("item", F.lit(i)), F.lit(2)) == 0
        moved = F.when(may_move & (-F.col("b.g") > F.col("stay")), F.col("b.community")).otherwise(F.col("mine"))
        labels = cut_lineage(best.select("item", moved.alias("community"), "k"))
    return labels.select("item", "community")


def communities(edges: DataFrame, rounds: int = 6, levels: int = 2) -> DataFrame:
    """(item, community) by repeated local moves and merging, weighted by ``weight``."""
    graph = cut_lineage(symmetric(edges.select("a", "b", "weight")).select("item", "other", F.col("weight").alias("w")))
    two_m = graph.agg(F.sum("w")).first()[0]
    assigned = None
    for _ in range(levels):
        moved = _local_moves(graph, two_m, rounds)
        if assigned is None:
            assigned = moved
        else:
            assigned = cut_lineage(
                assigned.join(moved.select(F.col("item").alias("community"), F.col("community").alias("up")), "community").select("item", F.col("up").alias("community"))
            )
        one = moved.select("item", F.col("community").alias("c1"))
        two = moved.select(F.col("item").alias("other"), F.col("community").alias("c2"))
        graph = cut_lineage(
            graph.join(one, "item").join(two, "other").groupBy(F.col("c1").alias("item"), F.col("c2").alias("other")).agg(F.sum("w").alias("w"))
        )
    return assigned


def modularity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: weighted modularity of an assignment(item, community)."""
    links = symmetric(edges.select("a", "b", "weight"))
    one = links.join(assigned, "item").join(assigned.select(F.col("item").alias("other"), F.col("community").alias("oc")), "other")
    per = one.groupBy("community").agg(
        F.sum("weight").alias("tot"), F.sum(F.when(F.col("community") == F.col("oc"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    two_m = per.agg(F.sum("tot")).scalar()
    return per.select("community", (F.col("inside") / two_m - (F.col("tot") / two_m) ** 2).alias("q")).agg(
        F.round(F.sum("q"), 6).alias("modularity"), F.count(F.lit(1)).alias("communities")
    )


def community_report(assigned: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """Leading members of every community with its size and flag counts.

    ``items(item, risk_score, is_cardiovascular, is_antithrombotic)``.
    """
    rows = assigned.join(items, "item")
    sizes = rows.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.col("is_cardiovascular").cast("int")).alias("cardiovascular"),
        F.sum(F.col("is_antithrombotic").cast("int")).alias("antithrombotic"),
    )
    w = Window.partitionBy("community").orderBy(F.desc("risk_score"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("community", "item", "risk_score", "rank").join(sizes, "community")
