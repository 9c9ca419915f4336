"""Severity scales and pair-level risk classes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combirisk.functions import rules
from combirisk.functions.text import any_of, once, text_marker_score
from combirisk.schemas import CONTRAINDICATED, LABELS, MAJOR, MINOR, MODERATE, NUMERIC_SCALE, Scale


def scale_value(label: str | Column, scale: Scale) -> Column:
    """Exact-label lookup; unknown and null take the scale's default."""
    c = F.col(label) if isinstance(label, str) else label
    table = F.create_map(*[F.lit(x) for kv in scale.values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(scale.default))


def scale_by_substring(label: str | Column, scale: Scale) -> Column:
    """First key contained in the lower-cased label wins."""
    c = F.lower(F.col(label) if isinstance(label, str) else label)
    hits = [F.when(c.contains(key), F.lit(value)) for key, value in scale.values.items()]
    return F.coalesce(*hits, F.lit(scale.default))


def numeric_label(numeric: Column) -> Column:
    return (
        F.when(numeric == 4, CONTRAINDICATED).when(numeric == 3, MAJOR).when(numeric == 2, MODERATE).when(numeric == 1, MINOR)
    )


def three_level(label: str | Column) -> Column:
    """Contraindicated and Major -> Major; other known labels lose the suffix; unknown stay."""
    c = F.col(label) if isinstance(label, str) else label
    return (
        F.when(c.isin(CONTRAINDICATED, MAJOR), "Major").when(c == MODERATE, "Moderate").when(c == MINOR, "Minor").otherwise(c)
    )


def severity_col(df: DataFrame) -> Column:
    """Best severity column the table has: calibrated, recalibrated, original."""
    for name in ("severity_calibrated", "severity_recalibrated", "severity_label"):
        if name in df.columns:
            return F.col(name)
    raise ValueError("no severity column")


def known_pair_label(name1: Column, name2: Column, contraindicated=None, major=None) -> Column:
    """Label of a listed pair by substring in either orientation, else null."""

    def listed(names, pairs) -> Column:
        a, b = names["a"], names["b"]
        hits = [(a.contains(p) & b.contains(q)) | (b.contains(p) & a.contains(q)) for p, q in pairs]
        return reduce(lambda x, y: x | y, hits)

    return once(
        F.struct(F.lower(F.trim(name1)).alias("a"), F.lower(F.trim(name2)).alias("b")),
        lambda names: F.when(listed(names, contraindicated or rules.KNOWN_CONTRAINDICATED), CONTRAINDICATED).when(
            listed(names, major or rules.KNOWN_MAJOR), MAJOR
        ),
    )


def name_classes(name: Column, classes: dict[str, list[str]]) -> Column:
    """Array of the risk classes whose members occur in the name."""
    return once(F.lower(F.trim(name)), lambda c: F.array_compact(F.array(*[F.when(any_of(c, members), F.lit(k)) for k, members in classes.items()])))


def pair_risk_class(name1: Column, name2: Column, classes=None) -> Column:
    both = F.struct(*[name_classes(n, classes or rules.RISK_CLASSES).alias(k) for k, n in (("one", name1), ("two", name2))])

    def of(found: Column) -> Column:
        one, two = found["one"], found["two"]
        shared = F.array_intersect(one, two)
        return (
            F.when(F.array_contains(shared, "maois"), "very_high")
            .when(F.array_contains(shared, "anticoagulants") | F.array_contains(shared, "qt_prolonging"), "high")
            .when((F.size(one) > 0) & (F.size(two) > 0), "elevated")
            .when((F.size(one) > 0) | (F.size(two) > 0), "moderate")
            .otherwise("standard")
        )

    return once(both, of)


def pair_class_score(name1: Column, name2: Column, classes=None) -> Column:
    """Numeric variant; the inhibitor-with-serotonergic combination scores 4.0."""
    table = classes or rules.SCORED_CLASSES
    one, two = name_classes(F.coalesce(name1, F.lit("")), table), name_classes(F.coalesce(name2, F.lit("")), table)
    shared = F.array_intersect(one, two)
    has = F.array_contains
    cross = (has(one, "maois") & has(two, "serotonergics")) | (has(two, "maois") & has(one, "serotonergics"))
    return (
        F.when(cross | has(shared, "maois"), 4.0)
        .when(has(shared, "anticoagulants") | has(shared, "qt_prolonging"), 3.5)
        .when((F.size(one) > 0) & (F.size(two) > 0), 3.0)
        .when((F.size(one) > 0) | (F.size(two) > 0), 2.5)
        .otherwise(2.0)
    )


def confidence_adjusted(label: Column, confidence: Column, top: float = 0.65, high: float = 0.45) -> Column:
    """Lower the numeric label when its confidence is too small."""
    n, conf = scale_value(label, NUMERIC_SCALE), F.coalesce(confidence, F.lit(0.5))
    return (
        F.when((n == 4) & (conf < top), 3.0).when((n >= 3) & (conf < high), 2.5).otherwise(n.cast("double"))
    )


def hybrid_recalibration(
    rows: DataFrame,
    weights: tuple[float, float, float] = (0.20, 0.50, 0.30),
    cuts: tuple[float, float, float] = (3.2, 2.5, 2.0),
) -> DataFrame:
    """Add severity_recalibrated, recal_method, recal_confidence, final_score.

    Each evidence source is its own column first, so that the long rule
    expressions are evaluated once per row however often they are used.
    """
    name1, name2, confidence = F.col("drug_name_1"), F.col("drug_name_2"), F.col("severity_confidence")
    class_scores = F.create_map(*[F.lit(x) for kv in rules.RISK_CLASS_SCORES.items() for x in kv])
    sourced = rows.select(
        "*",
        known_pair_label(name1, name2).alias("known_"),
        confidence_adjusted(F.col("severity_label"), confidence).alias("label_"),
        text_marker_score("interaction_description")["score"].alias("marker_"),
        pair_risk_class(name1, name2).alias("class_"),
    )
    # Scores are sums of two-decimal terms; rounding keeps the cuts exact.
    score = F.round(
        F.lit(weights[0]) * F.col("label_")
        + F.lit(weights[1]) * F.col("marker_")
        + F.lit(weights[2]) * F.element_at(class_scores, F.col("class_")),
        6,
    )
    scored = sourced.select("*", score.alias("score_"))
    s, known = F.col("score_"), F.col("known_")
    severity = F.when(s >= cuts[0], CONTRAINDICATED).when(s >= cuts[1], MAJOR).when(s >= cuts[2], MODERATE).otherwise(MINOR)
    return scored.select(
        *rows.columns,
        F.coalesce(known, severity).alias("severity_recalibrated"),
        F.when(known.isNotNull(), "known_pair").otherwise("hybrid").alias("recal_method"),
        F.when(known.isNotNull(), 0.95).otherwise(F.least(F.lit(0.95), confidence + 0.1)).alias("recal_confidence"),
        F.when(known.isNull(), s).alias("final_score"),
    )


def semantic_score(similarity: dict[str, Column], description: Column | None = None, thresholds=None) -> Column:
    """Score of the most severe class whose similarity reaches its threshold."""
    t = thresholds or rules.SEMANTIC_THRESHOLDS
    bands = (
        F.when(similarity["contraindicated"] >= t["contraindicated"], 4.0)
        .when(similarity["major"] >= t["major"], 3.2)
        .when(similarity["moderate"] >= t["moderate"], 2.0)
        .otherwise(1.5)
    )
    if description is None:
        return bands
    text = F.lower(description)
    return (
        F.when(description.isNull() | (F.trim(description) == ""), 2.0)
        .when(any_of(text, rules.SEMANTIC_OVERRIDE), 3.2)
        .otherwise(bands)
    )


def semantic_fallback(description: Column) -> Column:
    """Keyword score used where no vectors exist."""
    text = F.lower(F.coalesce(description, F.lit("")))
    hits = [F.when(any_of(text, kws), F.lit(score)) for score, _, kws in rules.SEMANTIC_FALLBACK]
    return (
        F.when(F.trim(text) == "", 2.0)
        .when(any_of(text, rules.SEMANTIC_OVERRIDE), 3.2)
        .otherwise(F.coalesce(*hits, F.lit(1.6)))
    )


def label_rank(label: Column) -> Column:
    """Most severe = 0 … least = 3, unknown = 4."""
    table = F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, i)])
    return F.coalesce(F.try_element_at(table, label), F.lit(len(LABELS)))
