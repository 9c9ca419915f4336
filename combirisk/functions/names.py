"""Names and free-text lists: normalising, splitting, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from combirisk.functions import rules


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(name: str | Column) -> Column:
    return F.lower(F.trim(_col(name)))


def split_list(text: str | Column) -> Column:
    """Split ``"a + b; c | d and e"`` on every accepted separator, order kept, no repeats."""
    c = F.lower(_col(text))
    # Accepted separators.
    for pattern in (r"\s*\+\s*", r"\s+and\s+", r"\s*[;|]\s*", r"\n+"):
        c = F.regexp_replace(c, pattern, ",")
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def strip_narrative(text: str | Column) -> Column:
    """Lower-cased text without doses, frequencies, times of day and dosage forms."""
    c = F.lower(_col(text))
    # Phrases that are not names.
    patterns = (
        r"\d+\s*(mg|ml|mcg|g|iu|units?)\b",
        r"\b(once|twice|thrice|\d+\s*times?)\s*(daily|a\s*day|per\s*day|weekly)?\b",
        r"\b(morning|evening|night|afternoon|bedtime|before|after|with)\s*(meals?|food|breakfast|lunch|dinner)?\b",
        r"\b(tablet|capsule|pill|dose|dosage)s?\b",
    )
    return reduce(lambda x, p: F.regexp_replace(x, p, " "), patterns, c)


def narrative_terms(text: str | Column) -> Column:
    """struct(unigrams, bigrams) of a cleaned narrative, each distinct."""
    cleaned = strip_narrative(text)
    tokens = F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")
    pairs = F.filter(
        F.transform(tokens, lambda w, i: F.concat_ws(" ", w, F.get(tokens, i + 1))),
        lambda p: p.contains(" ") & (F.length(p) >= 3),
    )
    words = F.filter(F.regexp_extract_all(cleaned, F.lit(r"\b([a-z]{2,})\b"), F.lit(1)), lambda w: F.length(w) >= 3)
    return F.struct(F.array_distinct(words).alias("unigrams"), F.array_distinct(pairs).alias("bigrams"))


def normal_name(name: str | Column, aliases: dict[str, str] | None = None, suffixes=None) -> Column:
    """Generic name without brackets, salt suffixes and doubled blanks."""
    c = clean_name(name)
    table = aliases if aliases is not None else rules.ALIASES
    if table:
        c = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    c = F.regexp_replace(c, r"\s*\([^)]*\)\s*", " ")
    for suffix in suffixes or rules.SALT_SUFFIXES:
        c = F.regexp_replace(c, rf"\s*{suffix}\s*$", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_similarity(one: str | Column, two: str | Column) -> Column:
    """.4 charset Jaccard + .3 length ratio + .3 common prefix (up to 5 characters)."""
    a, b = F.lower(_col(one)), F.lower(_col(two))
    chars = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))
    jaccard = F.size(F.array_intersect(chars(a), chars(b))) / F.size(F.array_union(chars(a), chars(b)))
    lengths = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    prefix = reduce(
        lambda x, y: x + y,
        [
            F.when(
                (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), 1
            ).otherwise(0)
            for n in range(1, 6)
        ],
    )
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, 0.0).otherwise(0.4 * jaccard + 0.3 * lengths + 0.3 * (prefix / 5.0))


def edit_ratio(one: str | Column, two: str | Column) -> Column:
    """1 - edit distance / longer length (stands in for sequence matching ratios)."""
    a, b = _col(one), _col(two)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaccard(one: str | Column, two: str | Column) -> Column:
    """Set similarity of two arrays; 0 if either is empty."""
    a, b = _col(one), _col(two)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0)
    )
