"""Hierarchical class codes: parsing, prefixes, labels, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combirisk.functions.rules import CODE_LEVEL1, CODE_LEVEL2, CODE_LEVEL4

# Prefix length of each level; level 5 is the full code.
LEVEL_LENGTHS = {1: 1, 2: 3, 3: 4, 4: 5, 5: 7}


def parse_code_list(text: str | Column) -> Column:
    """``"['B01AA03', 'C02']"`` -> array; null, ``[]`` and bad text -> empty array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(c, F.lit("'([^']+)'"), F.lit(1)), F.array().cast("array<string>"))


def split_codes(text: str | Column) -> Column:
    """``"A01|B02"`` -> trimmed array; null or blank -> empty array."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.transform(F.split(c, "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def code_level(code: str | Column, level: int) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.substring(c, 1, LEVEL_LENGTHS[level])


def prefix_index(items: DataFrame, id_col: str, codes_col: str, lengths=(1, 3, 4, 5)) -> DataFrame:
    """(id, prefix, plen): every code prefix of every item, plus the full code as plen 7."""
    code = F.explode(codes_col).alias("code")
    rows = items.select(F.col(id_col), code)
    cuts = F.array(
        *[
            F.struct(F.lit(n).alias("plen"), F.substring("code", 1, n).alias("prefix"), (F.length("code") >= n).alias("ok"))
            for n in lengths
        ],
        F.struct(F.lit(7).alias("plen"), F.col("code").alias("prefix"), F.lit(True).alias("ok")),
    )
    return (
        rows.select(id_col, F.explode(cuts).alias("cut"))
        .filter("cut.ok")
        .select(id_col, F.col("cut.prefix").alias("prefix"), F.col("cut.plen").alias("plen"))
        .distinct()
    )


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def level1_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(CODE_LEVEL1), F.substring(code, 1, 1)), F.lit("Unknown"))


def level2_label(code: Column) -> Column:
    prefix = F.substring(code, 1, 3)
    return F.when(code.isNull() | (F.length(code) < 3), F.lit("Unknown")).otherwise(
        F.coalesce(F.try_element_at(_lookup(CODE_LEVEL2), prefix), prefix)
    )


def level4_label(code: Column) -> Column:
    prefix = F.substring(code, 1, 5)
    return F.when(code.isNull() | (F.length(code) < 5), F.lit("Unknown")).otherwise(
        F.coalesce(F.try_element_at(_lookup(CODE_LEVEL4), prefix), prefix)
    )


def starts_any(codes: str | Column, prefix: str) -> Column:
    c = F.col(codes) if isinstance(codes, str) else codes
    return F.coalesce(F.exists(c, lambda x: x.startswith(prefix)), F.lit(False))


def primary_class(codes: str | Column) -> Column:
    """Label of the first C* or B01* code in list order, else "Other"."""
    c = F.col(codes) if isinstance(codes, str) else codes
    first = F.get(F.filter(c, lambda x: x.startswith("C") | x.startswith("B01")), F.lit(0))
    return (
        F.when(first.startswith("C"), level2_label(first))
        .when(first.startswith("B01"), level4_label(first))
        .otherwise(F.lit("Other"))
    )


def merged_flag(cardiovascular: Column, antithrombotic: Column) -> Column:
    return cardiovascular | antithrombotic


def pair_category(cv1: Column, at1: Column, cv2: Column, at2: Column) -> Column:
    """Six-way category of a pair from the flags of its sides."""
    return (
        F.when(cv1 & cv2, "Both Cardiovascular")
        .when(at1 & at2, "Both Antithrombotic")
        .when((cv1 & at2) | (at1 & cv2), "Cardiovascular + Antithrombotic")
        .when(cv1 | cv2, "Cardiovascular + Other")
        .when(at1 | at2, "Antithrombotic + Other")
        .otherwise("Other")
    )
