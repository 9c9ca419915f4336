"""Report-based item profiles and pair signals over reports(report_id, item, reaction, serious, death)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combirisk.operators.pairs import regimen_edges


def report_items(reports: DataFrame) -> DataFrame:
    """One row per (report, item) with its flags: distinct counts become plain sums."""
    return reports.groupBy("report_id", "item").agg(F.max("serious").alias("serious"), F.max("death").alias("death"))


def item_profiles(reports: DataFrame) -> DataFrame:
    """Totals, serious and death counts, ratios, and the capped and the log10 score."""
    counts = report_items(reports).groupBy("item").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("serious").cast("int")).alias("serious"), F.sum(F.col("death").cast("int")).alias("deaths")
    )
    one = F.lit(1.0)
    serious_ratio, death_ratio = F.col("serious") / F.col("total"), F.col("deaths") / F.col("total")
    capped = 0.4 * F.least(one, serious_ratio * 2) + 0.3 * F.least(one, death_ratio * 100) + 0.3 * F.least(one, F.col("total") / 100000.0)
    logged = (
        0.50 * F.least(one, F.log10(F.col("serious") + 1.0) / 6) + 0.30 * F.least(one, serious_ratio) + 0.20 * F.least(one, F.log10(F.col("total") + 1.0) / 6)
    )
    return counts.select("*", serious_ratio.alias("serious_ratio"), death_ratio.alias("death_ratio"), capped.alias("capped_score"), logged.alias("log_score"))


def top_reactions(reports: DataFrame, k: int = 10) -> DataFrame:
    counts = reports.select("report_id", "item", "reaction").distinct().groupBy("item", "reaction").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), F.asc("reaction"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_signals(reports: DataFrame, pairs: DataFrame, population: float | None = None) -> DataFrame:
    """Co-reported count of each listed pair(a, b) against its expectation n1 * n2 / N.

    ``population`` fixes N; by default N is the number of reports.  Reports are
    item lists, so pairs are found through the pair table, never by pairing
    everything inside a report.
    """
    members = report_items(reports).select(F.col("report_id").alias("regimen_id"), "item")
    together = regimen_edges(members, pairs.select("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    totals = members.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    n = F.lit(population) if population else members.agg(F.countDistinct("regimen_id")).scalar()
    one, two = totals.select(F.col("item").alias("a"), F.col("n").alias("n1")), totals.select(F.col("item").alias("b"), F.col("n").alias("n2"))
    rows = pairs.select("a", "b").join(one, "a").join(two, "b").join(together, ["a", "b"], "left").fillna(0, ["together"])
    return rows.withColumn("signal", F.col("together") / F.greatest(F.lit(1.0), F.col("n1") * F.col("n2") / n))


def common_reactions(reports: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, reaction, n, rank): leading reactions of the reports naming both items."""
    members = report_items(reports).select(F.col("report_id").alias("regimen_id"), "item")
    found = regimen_edges(members, pairs.select("a", "b")).withColumnRenamed("regimen_id", "report_id")
    reactions = reports.select("report_id", "reaction").distinct()
    counts = found.join(reactions, "report_id").groupBy("a", "b", "reaction").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("n"), F.asc("reaction"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
