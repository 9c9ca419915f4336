"""Counting, cross tables and profiles of interaction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.operators.quantiles import quartiles
from combirisk.session import scalar_row
from combirisk.schemas import CONTRAINDICATED, LABELS, MAJOR, MINOR, MODERATE, SEVERE_LABELS


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def value_counts(df: DataFrame, column: str | Column, name: str, decimals: int = 2) -> DataFrame:
    """(value, n, pct): counts with their share of all rows."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(name, "n", F.round(100.0 * F.col("n") / total, decimals).alias("pct"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per (row, value) as columns, their row shares, and a margin row (row = "All")."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    margin = counts.select(
        F.explode(F.array(F.struct(F.coalesce(row, F.lit("none")).alias("r")), F.struct(F.lit("All").alias("r")))).alias("x"), column, "n"
    ).select(F.col("x.r").alias(row), column, "n")
    cells = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(f"n_{i}") for i, v in enumerate(values)]
    table = margin.groupBy(row).agg(*cells, F.sum("n").alias("total"))
    shares = [F.round(100.0 * F.col(f"n_{i}") / F.col("total"), 2).alias(f"pct_{i}") for i in range(len(values))]
    return table.select(row, *[f"n_{i}" for i in range(len(values))], "total", *shares)


def both_sides(interactions: DataFrame, *extra: str) -> DataFrame:
    """One row per side of every interaction row: (item, flag columns, extra)."""
    side = lambda n: F.struct(
        F.col(f"drug_name_{n}").alias("item"),
        F.col(f"is_cardiovascular_{n}").alias("is_cardiovascular"),
        F.col(f"is_antithrombotic_{n}").alias("is_antithrombotic"),
    )
    return interactions.select(F.explode(F.array(side(1), side(2))).alias("s"), *extra).select("s.*", *extra)


def severity_counts(label: str = "severity_label") -> list[Column]:
    c = F.col(label)
    return [
        count_if(c == CONTRAINDICATED).alias("contraindicated"),
        count_if(c == MAJOR).alias("major"),
        count_if(c == MODERATE).alias("moderate"),
        count_if(c == MINOR).alias("minor"),
    ]


def item_counts(interactions: DataFrame) -> DataFrame:
    """Interactions per item, counted on both sides."""
    rows = both_sides(interactions, "severity_label")
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *severity_counts())


def item_profiles(interactions: DataFrame) -> DataFrame:
    """Counts per level (anything else counts as minor), mean numeric severity, risk score."""
    rows = both_sides(interactions, "severity_label", "severity_numeric")
    c = F.coalesce("severity_label", F.lit(""))
    counts = rows.groupBy("item").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(c.contains("Contraindicated")).alias("contraindicated"),
        count_if(c.contains("Major")).alias("major"),
        count_if(c.contains("Moderate")).alias("moderate"),
        count_if(~(c.contains("Contraindicated") | c.contains("Major") | c.contains("Moderate"))).alias("minor"),
        F.avg("severity_numeric").alias("avg_severity"),
        F.bool_or("is_cardiovascular").alias("is_cardiovascular"),
        F.bool_or("is_antithrombotic").alias("is_antithrombotic"),
    )
    score = 4 * F.col("contraindicated") + 3 * F.col("major") + 2 * F.col("moderate") + F.col("minor")
    return counts.withColumn("risk_score", score / F.greatest(F.col("total"), F.lit(1)))


def class_matrix(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(class1, class2, n), symmetric: off-diagonal cells are counted both ways."""
    one = classes.select(F.col("item").alias("a"), F.col("drug_class").alias("c1"))
    two = classes.select(F.col("item").alias("b"), F.col("drug_class").alias("c2"))
    pairs = edges.join(one, "a").join(two, "b").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    cells = F.when(
        F.col("c1") == F.col("c2"), F.array(F.struct(F.col("c1").alias("x"), F.col("c2").alias("y")))
    ).otherwise(
        F.array(
            F.struct(F.col("c1").alias("x"), F.col("c2").alias("y")), F.struct(F.col("c2").alias("x"), F.col("c1").alias("y"))
        )
    )
    return (
        pairs.select(F.explode(cells).alias("c"), "n").groupBy(F.col("c.x").alias("class1"), F.col("c.y").alias("class2")).agg(F.sum("n").alias("n"))
    )


def phenotype_summary(edges: DataFrame) -> DataFrame:
    """Per phenotype: total, counts per level, high-risk share."""
    rows = edges.select(F.explode("phenotypes").alias("phenotype"), "label")
    counts = rows.groupBy("phenotype").agg(F.count(F.lit(1)).alias("total"), *severity_counts("label"))
    return counts.withColumn("high_risk_pct", F.round(100.0 * (F.col("contraindicated") + F.col("major")) / F.col("total"), 2))


def top_phenotypes(edges: DataFrame, k: int = 5) -> DataFrame:
    """(label, phenotype, n, rank): the leading phenotypes of every level."""
    counts = edges.select("label", F.explode("phenotypes").alias("phenotype")).groupBy("label", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("phenotype"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def phenotype_cooccurrence(edges: DataFrame) -> DataFrame:
    """(p1, p2, n, p_given): joint counts and P(p2 | p1).

    The tags of one edge come from a fixed list, so expanding them twice is
    bounded by the square of that list.
    """
    joint = (
        edges.select(F.explode("phenotypes").alias("p1"), "phenotypes").select("p1", F.explode("phenotypes").alias("p2"))
        .groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    )
    own = joint.filter("p1 = p2").select("p1", F.col("n").alias("own"))
    return joint.join(own, "p1").select("p1", "p2", "n", F.round(F.col("n") / F.col("own"), 6).alias("p_given"))


def code_distribution(items: DataFrame) -> DataFrame:
    """items(item, l1, l2, pri): counts, share, mean and max per L1, and L1-L2 counts (rollup)."""
    total = items.agg(F.count(F.lit(1))).scalar()
    grouped = items.rollup("l1", "l2").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pri").alias("mean_pri"), F.max("pri").alias("max_pri"), F.grouping_id().alias("gid")
    )
    return grouped.filter("gid < 3").select(
        "l1", F.coalesce("l2", F.lit("all")).alias("l2"), "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"),
        F.round("mean_pri", 6).alias("mean_pri"), F.round("max_pri", 6).alias("max_pri"),
    )


def group_flow(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Counts per (group, label) with group and label totals by grouping sets."""
    flow = rows.groupingSets(
        [[F.col(group), F.col(label)], [F.col(group)], [F.col(label)], []], F.col(group), F.col(label)
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return flow.select(
        F.when(F.col("gid").isin(2, 3), "*").otherwise(F.col(group)).alias(group),
        F.when(F.col("gid").isin(1, 3), "*").otherwise(F.col(label)).alias(label),
        "n",
    )


def dataset_summary(interactions: DataFrame) -> DataFrame:
    """(measure, value) rows: sizes of the interaction table."""
    pair = F.struct(F.least("drug_name_1", "drug_name_2").alias("a"), F.greatest("drug_name_1", "drug_name_2").alias("b"))
    wide = interactions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(pair).alias("pairs"),
        count_if(F.col("severity_label").isNull()).alias("unlabelled"),
    )
    items = both_sides(interactions).groupBy("item").agg(
        F.bool_or("is_cardiovascular").alias("cv"), F.bool_or("is_antithrombotic").alias("at")
    ).agg(F.count(F.lit(1)).alias("items"), count_if(F.col("cv")).alias("cardiovascular"), count_if(F.col("at")).alias("antithrombotic"))
    melt = lambda df: df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in df.columns])).alias("m")
    ).select("m.*")
    return melt(wide).unionByName(melt(items))


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """N, mean, sample deviation, min, max per group, two decimals."""
    return df.groupBy(group).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 2).alias("mean"),
        F.round(F.stddev_samp(value), 2).alias("sd"),
        F.round(F.min(value), 2).alias("min"),
        F.round(F.max(value), 2).alias("max"),
    )


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n) over nodes(id, kind) and edges(src, dst, kind), with totals."""
    tagged = nodes.select(F.lit("nodes").alias("part"), "kind").unionByName(edges.select(F.lit("edges").alias("part"), "kind"))
    counted = tagged.rollup("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return counted.filter("gid < 3").select("part", F.when(F.col("gid") == 1, "*").otherwise(F.col("kind")).alias("kind"), "n")


def drift(rows: DataFrame, old: str, new: str, target: dict[str, float] | None = None) -> DataFrame:
    """(old, new, n, …) transition cells with old and new shares, target share and change rate."""
    cells = rows.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    changed = cells.agg(F.sum(F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("n")).otherwise(0))).scalar()
    w_old, w_new = Window.partitionBy("old"), Window.partitionBy("new")
    goal = F.create_map(*[F.lit(x) for kv in (target or {"": 0.0}).items() for x in kv])
    return cells.select(
        "old", "new", "n",
        F.round(F.sum("n").over(w_old) / total, 6).alias("old_share"),
        F.round(F.sum("n").over(w_new) / total, 6).alias("new_share"),
        F.try_element_at(goal, F.col("new")).alias("target_share"),
        F.round(changed / total, 6).alias("change_rate"),
    )


def shannon_divergence(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Jensen-Shannon divergence (natural log) between the old and new label shares."""
    # Rows are counted by both labels first: each row's label is worked out once, and the rest is a few rows.
    changes = rows.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda label, o, k: F.struct(F.col(label).alias("l"), o.alias("o"), k.alias("k"))
    none = F.lit(0).cast("long")
    both = changes.select(F.explode(F.array(side("old", F.col("n"), none), side("new", none, F.col("n")))).alias("x")).select("x.*")
    counts = both.groupBy("l").agg(F.sum("o").alias("o"), F.sum("k").alias("k"))
    total = counts.agg(F.sum("o")).scalar()
    p, q = F.col("o") / total, F.col("k") / total
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return counts.agg(F.round(F.sum((term(p) + term(q)) / 2), 6).alias("divergence"))


def method_counts(rows: DataFrame, method: str, old: str, new: str, confidence: str) -> DataFrame:
    """(method, n, share, changed, mean_confidence): what each way of relabelling did."""
    per = rows.groupBy(F.col(method).alias("method")).agg(F.count(F.lit(1)).alias("n"), count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"), F.avg(confidence).alias("mean"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("method", "n", F.round(F.col("n") / total, 6).alias("share"), "changed", F.round("mean", 6).alias("mean_confidence"))


def subset_rates(rows: DataFrame, subset: Column, label: str, confidence: str, before: str) -> DataFrame:
    """Rates inside a subset: share at least Major, share Moderate, mean confidence and its shift from ``before``."""
    return rows.filter(subset).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col(label).isin(SEVERE_LABELS), 1.0).otherwise(0.0)), 6).alias("severe_rate"),
        F.round(F.avg(F.when(F.col(label) == MODERATE, 1.0).otherwise(0.0)), 6).alias("moderate_rate"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"),
        F.round(F.avg(F.col(confidence) - F.col(before)), 6).alias("confidence_shift"),
    )


def consensus_distribution(levels: DataFrame, w1: float = 0.5, w2: float = 0.5) -> DataFrame:
    """levels(level, share1, share2) in percent -> average, weighted, conservative and clinical blends.

    Every method is rescaled to 100; ``consensus`` is the mean of the four.
    """
    a, b, level = F.col("share1"), F.col("share2"), F.col("level")
    conservative = F.when(level.isin("Contraindicated", "Major"), F.least(a, b)).otherwise((a + b) / 2)
    clinical = (
        F.when(level == "Contraindicated", b * 0.25)
        .when(level == "Major", (a + b * 0.67) / 2)
        .when(level == "Moderate", a * 0.7 + b * 0.3)
        .otherwise(a)
    )
    blends = levels.select(
        "level", ((a + b) / 2).alias("average"), (a * w1 + b * w2).alias("weighted"), conservative.alias("conservative"), clinical.alias("clinical")
    )
    names = ["average", "weighted", "conservative", "clinical"]
    # Four rows, one per level: the total is a window over the whole relation.
    w = Window.partitionBy(F.lit(1))
    shares = blends.select("level", *[(100.0 * F.col(n) / F.sum(n).over(w)).alias(n) for n in names])
    mean = reduce(lambda x, y: x + y, [F.col(n) for n in names]) / len(names)
    return shares.select("level", *[F.round(n, 6).alias(n) for n in names], F.round(mean, 6).alias("consensus"))


def confidence_distribution(rows: DataFrame, label: str, confidence: str, buckets: int = 10) -> DataFrame:
    """(label, bucket, n, high): histogram of confidence per label; bucket = tenth of the range."""
    bucket = F.least(F.floor(F.round(F.col(confidence) * buckets, 9)), F.lit(buckets - 1))
    return rows.groupBy(F.col(label).alias("label"), bucket.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(confidence) > 0.8).alias("high")
    )


# Risk-zone edges and names.
ZONE_EDGES = [0.2, 0.35, 0.5]
ZONE_NAMES = ["low", "moderate", "high", "critical"]


def risk_zone(pri: Column, include_lowest: bool = False, right_closed: bool = True) -> Column:
    """Zone of an index value; right-closed bins drop 0 unless ``include_lowest``."""
    below = (lambda e: pri <= e) if right_closed else (lambda e: pri < e)
    zone = (
        F.when(below(ZONE_EDGES[0]), ZONE_NAMES[0]).when(below(ZONE_EDGES[1]), ZONE_NAMES[1]).when(below(ZONE_EDGES[2]), ZONE_NAMES[2])
        .when(pri <= 1.0, ZONE_NAMES[3])
    )
    if right_closed and not include_lowest:
        return F.when(pri > 0, zone)
    return F.when(pri >= 0, zone)


def zone_table(items: DataFrame, zone: Column) -> DataFrame:
    """items(pri, severe, flagged) per zone: count, share, means, flagged share."""
    total = items.agg(F.count(F.lit(1))).scalar()
    return items.groupBy(zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100.0 * F.count(F.lit(1)) / total, 4).alias("pct"),
        F.round(F.avg("pri"), 6).alias("mean_pri"),
        F.round(F.avg("severe"), 6).alias("mean_severe"),
        F.round(100.0 * F.avg(F.col("flagged").cast("int")), 4).alias("flagged_pct"),
    )


def class_pair_rates(edges: DataFrame, classes: DataFrame, min_total: int = 100) -> DataFrame:
    """Unordered class pairs above a size: totals, severe count and rate."""
    one = classes.select(F.col("item").alias("a"), F.col("drug_class").alias("c1"))
    two = classes.select(F.col("item").alias("b"), F.col("drug_class").alias("c2"))
    rows = edges.join(one, "a").join(two, "b")
    grouped = rows.groupBy(F.least("c1", "c2").alias("class1"), F.greatest("c1", "c2").alias("class2")).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("label").isin(SEVERE_LABELS)).alias("severe")
    )
    return grouped.filter(F.col("total") > min_total).withColumn("rate", F.round(100.0 * F.col("severe") / F.col("total"), 4))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) of every column in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows_"), *[count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select("rows_", F.explode(cells).alias("x")).select(
        "x.*", F.round(100.0 * F.col("x.nulls") / F.col("rows_"), 4).alias("pct")
    )


def modal_label(rows: DataFrame, label: str = "severity_label") -> DataFrame:
    """(item, modal, n, total): the most frequent label, ties to the first by name."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy("item", label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("l"))).alias("best")
    return counts.groupBy("item").agg(best, F.sum("n").alias("total")).select(
        "item", F.col("best.l").alias("modal"), (-F.col("best.k")).alias("n"), "total"
    )


def histogram(df: DataFrame, value: str, buckets: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], the top edge closed; a column of one value is all top edge."""
    bounds = scalar_row(df, lo=F.min(value), hi=F.max(value))
    lo, hi = bounds["lo"], bounds["hi"]
    width = F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(1.0))
    bucket = F.floor(F.least(F.round(width * buckets, 9), F.lit(buckets - 1.0))).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, min, q25, q50, q75, max) of one column, by group."""
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    cuts = quartiles(df.select(F.col(group).alias("group"), F.col(value).alias("value")))
    return stats.join(cuts, F.col(group).eqNullSafe(F.col("group")), "left").select(
        group, "n", F.round("lo", 6).alias("min"), *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], F.round("hi", 6).alias("max"),
    )


def category_members(items: DataFrame, category: str, k: int = 10, members: int = 5) -> DataFrame:
    """Members (first by name) of the k largest categories, with category size."""
    sizes = items.groupBy(category).agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), F.asc(category)).limit(k)
    w = Window.partitionBy(category).orderBy("item")
    return items.join(top, category).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= members).select(category, "size", "item", "rank")


def high_risk_rows(rows: DataFrame, confidence: float = 0.7) -> DataFrame:
    return rows.filter((F.col("severity_label") == CONTRAINDICATED) & (F.col("severity_confidence") > confidence))


def rescale_three_to_four(three: DataFrame, four: DataFrame) -> DataFrame:
    """(level, share1, share2): a 3-level distribution stretched by another's severe split.

    Both inputs are (level, share) in percent; Major is divided into
    Contraindicated and Major in the proportion the 4-level source shows.
    """
    of = lambda level: F.max(F.when(F.col("level") == level, F.col("share")))
    wide = four.agg(of("Contraindicated").alias("c"), of("Major").alias("m"))
    ratio = wide.select(F.col("c") / (F.col("c") + F.col("m"))).scalar()
    major = F.col("level") == "Major"
    split = three.select(
        F.explode(
            F.when(
                major,
                F.array(
                    F.struct(F.lit("Contraindicated").alias("level"), (F.col("share") * ratio).alias("share1")),
                    F.struct(F.lit("Major").alias("level"), (F.col("share") * (1 - ratio)).alias("share1")),
                ),
            ).otherwise(F.array(F.struct(F.col("level").alias("level"), F.col("share").alias("share1"))))
        ).alias("x")
    ).select("x.*")
    return split.join(four.select("level", F.col("share").alias("share2")), "level")
