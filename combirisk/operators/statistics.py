"""Order statistics, correlations, rank tests and resampling as Spark jobs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.operators.profiles import count_if
from combirisk.operators.quantiles import quantile_values, quartiles, stacked
from combirisk.session import cut_lineage, scalar_row

# Number of value ranges a global running total is cut into.
RANGES = 64


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Inclusive running totals over one row per distinct ``order`` value.

    Input rows are first summed per value, so a value held by most rows is one
    row here.  The values are then cut into ranges by approximate quantiles;
    totals run inside each range in parallel and are shifted by the totals of
    the ranges before it (a table of at most ``RANGES`` rows).  Adds ``cum_*``.
    """
    # Read three times below, so the distinct values are computed once and kept.
    grouped = cut_lineage(df.filter(F.col(order).isNotNull()).groupBy(order).agg(*[F.sum(c).alias(c) for c in sums]))
    cuts = [i / RANGES for i in range(1, RANGES)]
    edges = grouped.agg(F.percentile_approx(order, cuts, 1000)).scalar()
    ranged = grouped.withColumn("edges_", edges).withColumn("range_", F.size(F.filter("edges_", lambda e: e < F.col(order)))).drop("edges_")
    direction = F.desc if descending else F.asc
    totals = ranged.groupBy("range_").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    before = Window.partitionBy(F.lit(1)).orderBy(direction("range_")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("range_", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"s_{c}") for c in sums])
    inside = Window.partitionBy("range_").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumns({f"r_{c}": F.sum(c).over(inside) for c in sums})
        .join(F.broadcast(shifts), "range_")
        .select(order, *sums, *[(F.col(f"r_{c}") + F.col(f"s_{c}")).alias(f"cum_{c}") for c in sums])
    )


def average_ranks(df: DataFrame, value: str, name: str, decimals: int | None = None) -> DataFrame:
    """Rank of every row by value, ties sharing their mean rank; null values get none."""
    keyed = df if decimals is None else df.withColumn(value, F.round(value, decimals))
    ranks = running_totals(keyed.withColumn("one_", F.lit(1)), value, ["one_"])
    rank = F.col("cum_one_") - (F.col("one_") - 1) / 2.0
    return keyed.join(ranks.select(value, rank.alias(name)), value, "left").select(*keyed.columns, name)


def descriptive(df: DataFrame, metrics: list[str], decimals: int = 6) -> DataFrame:
    """One row per metric: n, mean, population deviation, extremes, quartiles, skew, kurtosis."""
    rows = stacked(df, metrics)
    stats = rows.groupBy("group").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), decimals).alias("mean"),
        F.round(F.stddev_pop("value"), decimals).alias("sd"),
        F.round(F.min("value"), decimals).alias("min"),
        F.round(F.max("value"), decimals).alias("max"),
        F.round(F.skewness("value"), 4).alias("skew"),
        F.round(F.kurtosis("value"), 4).alias("kurtosis"),
    )
    found = stats.join(quartiles(rows), "group", "left")
    return found.select(
        F.col("group").alias("metric"), "n", "mean", "sd", "min", F.round("q25", decimals).alias("q25"), F.round("q50", decimals).alias("median"),
        F.round("q75", decimals).alias("q75"), "max", "skew", "kurtosis",
    )


def describe(df: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numeric columns; std is the sample's."""
    rows = stacked(df, columns)
    stats = rows.groupBy("group").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    shown = [F.round(c, decimals).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return stats.join(quartiles(rows), "group", "left").select(F.col("group").alias("column"), "count", *shown)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both values; NaN if one column is constant, null without rows."""
    one, two = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    together = F.covar_pop(one, two)
    return F.when(together.isNotNull(), F.coalesce(F.try_divide(together, F.stddev_pop(one) * F.stddev_pop(two)), F.lit(float("nan"))))


def correlation_matrix(df: DataFrame, metrics: list[str], method: str = "pearson", decimals: int = 6) -> DataFrame:
    """(x, y, r) of every metric pair; ``spearman`` correlates average ranks."""
    table, names = df, {m: m for m in metrics}
    if method == "spearman":
        table = cut_lineage(df.select(*metrics))
        for m in metrics:
            table = average_ranks(table, m, f"rank_{m}")
        names = {m: f"rank_{m}" for m in metrics}
    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.round(correlation(names[x], names[y]), decimals).alias("r"))
        for x, y in combinations(metrics, 2)
    ]
    return table.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def cumulative_share(df: DataFrame, value: str) -> DataFrame:
    """Lorenz / Pareto points per distinct value, largest first: share of rows and of the total."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(1).alias("k"), F.col(value).alias("amount"))
    run = running_totals(rows, "v", ["k", "amount"], descending=True)
    totals = scalar_row(run, k=F.sum("k"), amount=F.sum("amount"))
    n, total = totals["k"], totals["amount"]
    return run.select(F.col("v").alias("value"), (F.col("cum_k") / n).alias("row_share"), (F.col("cum_amount") / total).alias("value_share"))


def quantile_edges(df: DataFrame, value: str, k: int = 5) -> Column:
    """Array of the inner quantile edges, repeated edges dropped."""
    edges = quantile_values(df, value, [i / k for i in range(0, k + 1)])
    return F.array_distinct(F.array(*[F.lit(e).cast("double") for e in edges]))


def quantile_bins(df: DataFrame, value: str, k: int = 5, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins 0..; equal edges merge, the lowest value is in bin 0."""
    upper = F.size(F.filter("edges_", lambda e: e < F.col(value)))
    return df.withColumn("edges_", quantile_edges(df, value, k)).withColumn(name, F.greatest(upper - 1, F.lit(0))).drop("edges_")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, rational approximation good to 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Published coefficients of the error-function approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def float_divide(x: Column, y: Column) -> Column:
    """x / y as floating-point numbers have it: by 0 gives an infinity, or NaN for 0 / 0."""
    by_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """U of the first group with z and p-values (tie-corrected, continuity-corrected).

    Where all values are equal or a group is empty, nothing spreads and z is infinite.
    """
    rows = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(value, group)
    counted = rows.groupBy(value).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(group) == first).alias("n_first")
    )
    run = running_totals(counted, value, ["n", "n_first"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    sums = run.agg(
        F.sum("n").alias("total"),
        F.sum("n_first").alias("n1"),
        F.sum(F.col("n_first") * rank).alias("r1"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"),
    )
    n1, n, n2 = F.col("n1"), F.col("total"), F.col("total") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - float_divide(F.col("ties"), n * (n - 1.0))))
    staged = sums.select(n1.alias("n1"), n2.alias("n2"), u.alias("u"), (n1 * n2 / 2.0).alias("mean"), spread.alias("spread"))
    greater = float_divide(F.col("u") - F.col("mean") - 0.5, F.col("spread"))
    two_sided = float_divide(F.abs(F.col("u") - F.col("mean")) - 0.5, F.col("spread"))
    return staged.select(
        "n1", "n2", F.round("u", 4).alias("u"),
        F.round(greater, 6).alias("z"),
        F.round(upper_tail(greater), 6).alias("p_greater"),
        F.round(F.least(F.lit(1.0), 2 * upper_tail(two_sided)), 6).alias("p_two_sided"),
    )


def roc(df: DataFrame, score: str, outcome: str) -> DataFrame:
    """Area under the curve and the threshold with the largest tpr - fpr.

    ``outcome`` is 0/1; points are taken at distinct scores from the top.
    """
    run, pos, neg = _roc_run(df, score, outcome)
    tpr, fpr = F.col("cum_pos") / pos, F.col("cum_neg") / neg
    # Pairs won by the positives of a score: every negative below it, half of its own.
    won = F.col("pos") * (neg - F.col("cum_neg") + F.col("neg") / 2.0)
    best = F.max(F.struct(F.round(tpr - fpr, 9).alias("j"), F.col(score).alias("t"), tpr.alias("tpr"), fpr.alias("fpr"))).alias("b")
    return run.agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), best).select(
        F.round(F.col("won") / (F.col("p") * F.col("n")), 6).alias("auc"),
        F.col("b.t").alias("threshold"),
        F.round("b.tpr", 6).alias("sensitivity"),
        F.round(1 - F.col("b.fpr"), 6).alias("specificity"),
    )


def roc_curve(df: DataFrame, score: str, outcome: str) -> DataFrame:
    run, pos, neg = _roc_run(df, score, outcome)
    return run.select(F.col(score).alias("threshold"), F.round(F.col("cum_pos") / pos, 6).alias("tpr"), F.round(F.col("cum_neg") / neg, 6).alias("fpr"))


def _roc_run(df: DataFrame, score: str, outcome: str):
    rows = df.select(score, F.col(outcome).cast("long").alias("pos"), (1 - F.col(outcome)).cast("long").alias("neg"))
    run = running_totals(rows, score, ["pos", "neg"], descending=True)
    totals = scalar_row(run, pos=F.sum("pos"), neg=F.sum("neg"))
    return run, totals["pos"], totals["neg"]


def hash_number(*parts: Column) -> Column:
    """32-bit number from the md5 of the joined parts: the same draw in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def bootstrap_correlation(df: DataFrame, id_col: str, x: str, y: str, replicates: int = 1000, seed: int = 42, method: str = "spearman") -> DataFrame:
    """Correlation with its percentile interval from seeded resampling.

    Replicate r draws n rows with replacement: draw j takes the row whose
    place in id-hash order is hash(seed, r, j) mod n.  Draws are generated and
    correlated per replicate in parallel; no resample is ever collected.
    """
    rows = cut_lineage(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(id_col, F.col(x).alias("x"), F.col(y).alias("y")))
    hashed = rows.withColumn("hash_", hash_number(F.lit(seed), F.col(id_col)))
    indexed = cut_lineage(global_rank(hashed, "hash_", id_col, "place", descending=False).withColumn("place", F.col("place") - 1))
    n = rows.agg(F.count(F.lit(1))).scalar()
    slots = indexed.select(F.col("place").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = slots.select("replicate", (hash_number(F.lit(seed), F.col("replicate"), F.col("slot")) % n).alias("place"))
    sample = draws.join(indexed.select("place", "x", "y"), "place")
    if method == "spearman":
        ranked = lambda c: (
            F.rank().over(Window.partitionBy("replicate").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("replicate", c)) - 1) / 2.0
        )
        sample = sample.select("replicate", ranked("x").alias("x"), ranked("y").alias("y"))
        whole = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry").agg(correlation("rx", "ry").alias("r"))
    else:
        whole = rows.agg(correlation("x", "y").alias("r"))
    each = sample.groupBy("replicate").agg(correlation("x", "y").alias("r"))
    q = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    return each.agg(q, F.count("r").alias("replicates")).select(
        F.round(whole.scalar(), 6).alias("r"),
        F.round(F.get("q", F.lit(0)), 6).alias("ci_low"),
        F.round(F.get("q", F.lit(1)), 6).alias("ci_high"),
        "replicates",
    )


def global_rank(df: DataFrame, value: str, id_col: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """1-based place by value, ties by id, without one global sort task."""
    run = running_totals(df.select(value, F.lit(1).alias("one_")), value, ["one_"], descending=descending)
    before = run.select(F.col(value).alias("v_"), (F.col("cum_one_") - F.col("one_")).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(value).orderBy(id_col))
    return (
        df.withColumn("in_", inside).join(before, F.col(value) == F.col("v_")).select(*df.columns, (F.col("before_") + F.col("in_")).alias(name))
    )
