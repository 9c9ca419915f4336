"""Text rules over interaction descriptions, as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from combirisk.functions import rules
from combirisk.schemas import CONTRAINDICATED, MAJOR, MINOR, MODERATE


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(text: Column, keywords) -> Column:
    """True if any keyword is a substring."""
    return reduce(lambda x, y: x | y, [text.contains(k) for k in keywords])


def first_of(text: Column, keywords) -> Column:
    """The first listed keyword found in the text, else null."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in keywords])


def whole_word(text: Column, phrase: str) -> Column:
    """Phrase bounded by word edges; the substring test spares most regex runs."""
    return text.contains(phrase) & text.rlike(rf"\b{re.escape(phrase)}\b")


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` with the value worked out a single time, however often the rule reads it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def _lowered(description: str | Column) -> Column:
    return F.lower(F.coalesce(_col(description), F.lit("")))


def phenotype_tags(description: str | Column, table=None) -> Column:
    text = _lowered(description)
    tags = [F.when(any_of(text, kws), F.lit(name)) for name, kws in (table or rules.PHENOTYPES).items()]
    return F.array_compact(F.array(*tags))


def mechanism(description: str | Column) -> Column:
    text = _lowered(description)

    def hits(groups, prefix):
        return [
            F.when(reduce(lambda x, y: x | y, [text.rlike(p) for p in patterns]), F.lit(prefix + name))
            for name, patterns in groups.items()
        ]

    return F.coalesce(*hits(rules.PK_MECHANISMS, "pk_"), *hits(rules.PD_MECHANISMS, "pd_"), F.lit("unknown"))


def clinical_effect(description: str | Column) -> Column:
    c, text = _col(description), _lowered(description)
    hits = [F.when(any_of(text, kws), F.lit(name)) for name, kws in rules.CLINICAL_EFFECTS.items()]
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(F.coalesce(*hits, F.lit("general")))


def interaction_type(description: str | Column) -> Column:
    text = _lowered(description)
    hits = [F.when(any_of(text, kws), F.lit(name)) for name, kws in rules.INTERACTION_TYPES.items()]
    return F.coalesce(*hits, F.lit("Other"))


def interaction_type_code(description: str | Column) -> Column:
    text = _lowered(description)
    groups = rules.INTERACTION_TYPE_CODES
    return F.coalesce(*[F.when(any_of(text, kws), F.lit(i)) for i, kws in enumerate(groups)], F.lit(len(groups)))


def keyword_score(description: str | Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of the weights of the keywords present; null text scores 0.

    Weights have two decimals, so they are summed as whole hundredths: the
    score does not depend on the order of the additions.
    """
    table = weights or rules.KEYWORD_WEIGHTS

    def hundredths(text):
        return reduce(lambda x, y: x + y, [F.when(text.contains(k), F.lit(int(round(w * 100)))).otherwise(0) for k, w in table.items()])

    return once(_lowered(description), hundredths) / F.lit(100.0)


def learned_score(description: str | Column, weights: dict[str, float]) -> Column:
    """As :func:`keyword_score` for weights of any precision."""
    text = _lowered(description)
    parts = [F.when(text.contains(k), F.lit(float(w))).otherwise(0.0) for k, w in weights.items()]
    return reduce(lambda x, y: x + y, parts, F.lit(0.0))


def rule_severity(description: str | Column, score: str | Column | None = None) -> Column:
    """struct(severity, confidence, method, score, keyword) by fixed score thresholds.

    Score bands come first, then the keyword lists in order, then the default.
    Pass ``score`` as a column computed beforehand: it is used in every branch.
    """
    text, score = _lowered(description), keyword_score(description) if score is None else _col(score)
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row(severity, confidence, method, score_=none_d, keyword=none_s):
        return F.struct(
            F.lit(severity).alias("severity"),
            (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
            F.lit(method).alias("method"),
            score_.alias("score"),
            keyword.alias("keyword"),
        )

    labels = {"contraindicated": CONTRAINDICATED, "major": MAJOR, "moderate": MODERATE, "minor": MINOR}
    out = (
        F.when(score >= 2.5, row(CONTRAINDICATED, F.least(F.lit(0.90), F.round(0.70 + score * 0.05, 6)), "empirical", score))
        .when(score >= 1.8, row(MAJOR, F.least(F.lit(0.85), F.round(0.65 + score * 0.05, 6)), "empirical", score))
        .when(score <= -1.5, row(MINOR, 0.70, "empirical", score))
        .when(score > 0, row(MODERATE, 0.75, "empirical", score))
    )
    for level, keywords in rules.FALLBACK_KEYWORDS.items():
        method = "rule_based" if level == "minor" else "keyword_fallback"
        found = first_of(text, keywords)
        out = out.when(
            any_of(text, keywords), row(labels[level], rules.FALLBACK_CONFIDENCE[level], method, none_d, found)
        )
    return out.otherwise(row(MODERATE, 0.50, "default"))


def text_marker_score(description: str | Column) -> Column:
    """struct(score, evidence, marker): first marker group found, longer markers first."""
    c = _col(description)
    by_length = lambda words: sorted(words, key=len, reverse=True)
    groups = [
        (4.0, "contra_effect", rules.CONTRA_EFFECTS),
        (3.2, "major_effect", by_length(rules.MAJOR_EFFECTS)),
        (4.0, "strong_contra", rules.CONTRA_STRONG),
        (3.0, "strong_major", rules.MAJOR_STRONG),
        (2.0, "moderate_effect", by_length(rules.MODERATE_EFFECTS)),
        (1.5, "minor_effect", rules.MINOR_EFFECTS),
    ]

    def row(score, evidence, marker):
        return F.struct(F.lit(score).alias("score"), F.lit(evidence).alias("evidence"), marker.alias("marker"))

    none = F.lit(None).cast("string")

    def found(text):
        out = F.when(c.isNull(), row(*rules.MARKER_NULL, none))
        for score, evidence, markers in groups:
            out = out.when(any_of(text, markers), row(score, evidence, first_of(text, markers)))
        return out.otherwise(row(*rules.MARKER_DEFAULT, none))

    return once(_lowered(description), found)


def evidence_class(description: str | Column) -> Column:
    """struct(severity, confidence, evidence): pair rules, interval rule, whole-word patterns."""
    c, text = _col(description), _lowered(description)

    def row(severity, confidence, evidence):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            F.lit(severity).alias("severity"), as_col(confidence).alias("confidence"), as_col(evidence).alias("evidence")
        )

    out = F.when(c.isNull() | (c == ""), row("Moderate", 0.5, "Default - No description"))
    for one, two, severity, evidence in rules.EVIDENCE_PAIRS:
        out = out.when(text.contains(one) & text.contains(two), row(severity, 0.90, evidence))
    named = reduce(lambda x, y: x + y, [text.contains(n).cast("int") for n in rules.QT_NAMES])
    out = out.when(named >= 2, row(*rules.EVIDENCE_QT))

    def matched(severity, found):
        confidence = F.least(F.lit(0.99), rules.EVIDENCE_BASE[severity] + F.least(F.lit(0.1), F.size(found) * 0.02))
        return F.when(F.size(found) > 0, row(severity, F.round(confidence, 6), F.get(found, F.lit(0))))

    # Bound to a name inside ``transform``, so that the patterns of a severity are tried once for each text.
    staged = []
    for severity, patterns in rules.EVIDENCE_PATTERNS.items():
        found = F.array_compact(F.array(*[F.when(whole_word(text, p), F.lit(ref)) for p, ref in patterns.items()]))
        staged.append(F.get(F.transform(F.array(found), partial(matched, severity)), F.lit(0)))
    return F.coalesce(out, *staged, row("Moderate", 0.5, "Default - No specific pattern matched"))


# Fields of the staged classification, in rule-table order.
STAGED_FIELDS = (
    "seriousness", "consequence", "frequency", "mechanism", "action", "quality", "reference", "confidence", "legacy",
)


def staged_class(description: str | Column) -> Column:
    """Nine-field seriousness record: absolute pairs, high pairs, interval names, patterns."""
    c = _col(description)

    def row(*values):
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, STAGED_FIELDS)])

    def staged(text):
        out = F.when(c.isNull() | (c == ""), row(*rules.STAGED_EMPTY))
        for one, two, *rest in rules.STAGED_CONTRAINDICATED:
            out = out.when(text.contains(one) & text.contains(two), row("Contraindicated", *rest, 0.95, "Contraindicated"))
        for one, two, *rest in rules.STAGED_HIGH:
            out = out.when(text.contains(one) & text.contains(two), row("High", *rest, 0.85, "Major"))
        found = F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in rules.STAGED_QT_NAMES]))
        names = F.array_join(F.slice(found, 1, 2), ", ")
        qt = list(rules.STAGED_QT)
        out = out.when(F.size(found) >= 2, row(qt[0], F.concat(F.lit(qt[1] + " from "), names), *qt[2:]))
        for pattern, seriousness, *rest in rules.STAGED_PATTERNS:
            *fields, legacy = rest
            confidence = 0.7 if seriousness == "High" else 0.6
            out = out.when(whole_word(text, pattern), row(seriousness, *fields, confidence, legacy))
        return out.otherwise(row(*rules.STAGED_DEFAULT))

    return once(_lowered(description), staged)


def baseline_class(description: str | Column) -> Column:
    """struct(severity, confidence) of the plain keyword baseline."""
    row = lambda s, k: F.struct(F.lit(s).alias("severity"), F.lit(k).alias("confidence"))
    hits = lambda text: [F.when(any_of(text, kws), row(s, k)) for s, k, kws in rules.BASELINE_RULES]
    return once(_lowered(description), lambda text: F.coalesce(*hits(text), row(*rules.BASELINE_DEFAULT)))


def readability(text: str | Column) -> Column:
    """struct(avg_sentence_length, vocabulary_richness)."""
    c = F.coalesce(_col(text), F.lit(""))
    sentences = F.filter(F.split(c, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    distinct = F.size(F.array_distinct(F.transform(words, F.lower)))
    return F.struct(
        (F.size(words) / F.greatest(F.size(sentences), F.lit(1))).alias("avg_sentence_length"),
        (distinct / F.greatest(F.size(words), F.lit(1))).alias("vocabulary_richness"),
    )


def count_occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed word."""
    return F.regexp_count(text, F.lit(re.escape(word)))
