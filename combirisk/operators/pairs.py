"""Unordered pairs: canonical edges, lookups, and pairs inside lists of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.functions.severity import numeric_label, scale_value
from combirisk.schemas import NUMERIC_SCALE, WEIGHT_SCALE
from combirisk.session import cut_lineage

# Lists up to this many items are paired with themselves; longer ones go
# through the edges, so no group ever emits all of its pairs.
SELF_PAIR_LIMIT = 64

# Attributes that up to this many items hold are met through the attribute;
# commoner ones through sets of the two items of a pair.
RARE_HOLDERS = 64

# Attributes that one row of a packed set should hold; larger sets take several rows.
SET_SIZE = 1024


def pair_key(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def canonical(interactions: DataFrame) -> DataFrame:
    """Directed rows reduced to (a, b, numeric, description, confidence)."""
    return interactions.select(
        *pair_key(F.col("drug_name_1"), F.col("drug_name_2")),
        F.coalesce(F.col("severity_numeric"), F.lit(NUMERIC_SCALE.default)).alias("numeric"),
        F.coalesce(F.col("interaction_description"), F.lit("")).alias("description"),
        F.col("severity_confidence").alias("confidence"),
    )


def severity_columns(numeric: Column) -> list[Column]:
    """A severity number with its label and weight."""
    label = numeric_label(numeric)
    return [numeric.alias("numeric"), label.alias("label"), scale_value(label, WEIGHT_SCALE).alias("weight")]


def max_severity_edges(interactions: DataFrame) -> DataFrame:
    """One row per pair: highest severity, ties to the lowest description.

    A single grouped ``min`` over an ordered struct, so partial aggregation
    shrinks repeated pairs before the shuffle.
    """
    best = F.min(F.struct((-F.col("numeric")).alias("n"), "description", "confidence")).alias("best")
    grouped = canonical(interactions).groupBy("a", "b").agg(best, F.count(F.lit(1)).alias("n_rows"))
    return grouped.select(
        "a",
        "b",
        *severity_columns(-F.col("best.n")),
        F.col("best.description").alias("description"),
        F.col("best.confidence").alias("confidence"),
        "n_rows",
    )


def pick_edges(interactions: DataFrame, policy: str = "max", order: str = "interaction_description") -> DataFrame:
    """Resolve repeated pairs: ``max`` severity, ``first``/``last`` in a stated order, or ``all``."""
    if policy == "max":
        return max_severity_edges(interactions)
    keyed = interactions.select(*pair_key(F.col("drug_name_1"), F.col("drug_name_2")), "*")
    if policy == "all":
        return keyed
    pick = F.min_by if policy == "first" else F.max_by
    rank = F.struct(F.coalesce(F.col(order), F.lit("")).alias("o"), "severity_numeric", "severity_confidence", "drug_name_1")
    return (
        keyed.groupBy("a", "b")
        .agg(pick(F.struct("severity_label", "severity_numeric", "interaction_description", "severity_confidence"), rank).alias("row"))
        .select("a", "b", "row.*")
    )


def symmetric(edges: DataFrame, one: str = "a", two: str = "b") -> DataFrame:
    """Both directions of every edge as (item, other, …)."""
    rest = [c for c in edges.columns if c not in (one, two)]
    both = F.explode(
        F.array(
            F.struct(F.col(one).alias("item"), F.col(two).alias("other")),
            F.struct(F.col(two).alias("item"), F.col(one).alias("other")),
        )
    ).alias("e")
    return edges.select(both, *rest).select("e.item", "e.other", *rest)


def regimen_sizes(regimens: DataFrame) -> DataFrame:
    return regimens.groupBy("regimen_id").agg(F.count(F.lit(1)).alias("n"))


def split_by_size(regimens: DataFrame, limit: int = SELF_PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Members (regimen_id, item, n) of lists of up to ``limit`` items, and of longer ones."""
    sized = regimens.select("regimen_id", "item").join(regimen_sizes(regimens), "regimen_id")
    return sized.filter(F.col("n") <= limit), sized.filter(F.col("n") > limit)


def item_pairs(members: DataFrame) -> DataFrame:
    """(regimen_id, a, b) with a < b by an equi-join on the regimen."""
    left = members.select("regimen_id", F.col("item").alias("a"))
    right = members.select("regimen_id", F.col("item").alias("b"))
    return left.join(right, "regimen_id").filter(F.col("a") < F.col("b"))


def regimen_edges(regimens: DataFrame, edges: DataFrame, limit: int = SELF_PAIR_LIMIT) -> DataFrame:
    """Edges whose two ends are both in the regimen, for every regimen of the table.

    Short lists are paired with themselves and looked up.  Longer lists start
    from the edges of their items and keep those whose other end is a member
    too: the work follows the edges, never the square of the list.
    """
    short, long = split_by_size(regimens, limit)
    from_pairs = item_pairs(short).join(edges, ["a", "b"])
    one = long.select("regimen_id", F.col("item").alias("a"))
    two = long.select("regimen_id", F.col("item").alias("b"))
    from_edges = one.join(edges, "a").join(two, ["regimen_id", "b"])
    columns = ["regimen_id", *edges.columns]
    return from_pairs.select(*columns).unionByName(from_edges.select(*columns))


def by_holders(attributes: DataFrame, most: int = RARE_HOLDERS) -> tuple[DataFrame, DataFrame]:
    """Rows of attributes that 2 to ``most`` items hold, and rows of commoner ones."""
    counted = attributes.groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
    rare = attributes.select("item", "attr").join(counted.filter(F.col("n").between(2, most)), "attr", "left_semi")
    return rare, attributes.select("item", "attr").join(counted.filter(F.col("n") > most), "attr", "left_semi")


def rare_triples(rare: DataFrame) -> DataFrame:
    """(a, b, attr) of all pairs that share a rare attribute: at most half of ``RARE_HOLDERS`` rows for each given one."""
    one = rare.select("attr", F.col("item").alias("a"))
    return one.join(rare.select("attr", F.col("item").alias("b")), "attr").filter(F.col("a") < F.col("b"))


def packed_sets(attributes: DataFrame, size: int = SET_SIZE) -> DataFrame:
    """(item, blocks, block, attrs): the set of every item, cut by hash into a power of two of blocks."""
    counted = attributes.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / size)))).cast("int")
    rows = attributes.join(counted.select("item", blocks.alias("blocks")), "item")
    return rows.groupBy("item", "blocks", F.pmod(F.xxhash64("attr"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("attr").alias("attrs"))


def common_sets(pairs: DataFrame, common: DataFrame, size: int = SET_SIZE) -> DataFrame:
    """(a, b, attrs) of the given pairs over common attributes: the two packed sets are intersected once for each pair.

    The set with more blocks sets the number of steps of a pair.  Blocks are nested
    powers of two, so an attribute meets itself in exactly one step.
    """
    sets = packed_sets(common, size)
    blocks = sets.select("item", "blocks").distinct()
    one, two = (blocks.select(F.col("item").alias(c), F.col("blocks").alias(f"n_{c}")) for c in "ab")
    steps = F.explode(F.sequence(F.lit(0), F.greatest("n_a", "n_b") - 1)).alias("step")
    wanted = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", steps)
    wanted = wanted.select("a", "b", F.pmod("step", "n_a").alias("block_a"), F.pmod("step", "n_b").alias("block_b"))
    left, right = (sets.select(F.col("item").alias(c), F.col("block").alias(f"block_{c}"), F.col("attrs").alias(f"attrs_{c}")) for c in "ab")
    met = wanted.join(left, ["a", "block_a"]).join(right, ["b", "block_b"])
    return met.select("a", "b", F.array_intersect("attrs_a", "attrs_b").alias("attrs"))


def common_triples(pairs: DataFrame, common: DataFrame, size: int = SET_SIZE) -> DataFrame:
    """(a, b, attr) of the given pairs over common attributes."""
    return common_sets(pairs, common, size).select("a", "b", F.explode("attrs").alias("attr"))


def shared_triples(pairs: DataFrame, attributes: DataFrame, most: int = RARE_HOLDERS) -> DataFrame:
    """(a, b, attr) of the given distinct pairs (a < b); the work does not depend on how often a pair occurs."""
    rare, common = by_holders(attributes, most)
    return rare_triples(rare).join(pairs, ["a", "b"], "left_semi").select("a", "b", "attr").unionByName(common_triples(pairs, common))


def shared_counts(pairs: DataFrame, attributes: DataFrame, most: int = RARE_HOLDERS) -> DataFrame:
    """(a, b, n_shared) of the given distinct pairs (a < b) that share an attribute.

    Pairs that meet through a rare attribute are counted inside the tasks of that
    join, so neither names nor sets of attributes travel with a pair.
    """
    rare, common = by_holders(attributes, most)
    met = rare_triples(rare).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    counted = met.unionByName(common_sets(pairs, common).select("a", "b", F.size("attrs").cast("long").alias("n_shared")))
    counted = counted.groupBy("a", "b").agg(F.sum("n_shared").alias("n_shared")).filter("n_shared > 0")
    return counted.join(pairs.select("a", "b"), ["a", "b"], "left_semi")


def overlap_edges(regimens: DataFrame, attributes: DataFrame, *measures: Column, ranked: bool = False, limit: int = SELF_PAIR_LIMIT, most: int = RARE_HOLDERS) -> DataFrame:
    """(a, b, measures) of every pair of items that shares an attribute and may meet in a regimen.

    ``measures`` aggregate over ``attr``, and over its alphabetical place ``rank_``
    in the pair if ``ranked``.  The table is keyed like edges: pairs come from rare
    attributes, whatever lists they are in, and over common attributes from the
    distinct pairs of short lists and the sharing pairs of long ones.
    """
    rare, common = by_holders(attributes, most)
    short, long = split_by_size(regimens, limit)
    pairs = item_pairs(short).select("a", "b").unionByName(shared_attributes(long, common, limit).select("a", "b")).distinct()
    triples = rare_triples(rare).select("a", "b", "attr").unionByName(common_triples(pairs, common))
    if ranked:
        triples = triples.withColumn("rank_", F.row_number().over(Window.partitionBy("a", "b").orderBy("attr")))
    return triples.groupBy("a", "b").agg(*measures)


def regimen_overlaps(regimens: DataFrame, attributes: DataFrame, *measures: Column, ranked: bool = False, limit: int = SELF_PAIR_LIMIT, most: int = RARE_HOLDERS) -> DataFrame:
    """(regimen_id, a, b, measures) of every pair of a regimen that shares an attribute; see ``overlap_edges``."""
    # Short and long lists both read the table of pairs.
    per_pair = cut_lineage(overlap_edges(regimens, attributes, *measures, ranked=ranked, limit=limit, most=most))
    return regimen_edges(regimens, per_pair, limit)


def shared_attributes(regimens: DataFrame, attributes: DataFrame, limit: int = SELF_PAIR_LIMIT) -> DataFrame:
    """(regimen_id, a, b, attr): pairs of a regimen that share an attribute.

    The join key is (regimen, attribute).  Long lists get a salt on top: one
    side is spread over several keys and the other repeated for each of them,
    so one regimen's rows never meet in a single task.
    """
    sized = regimens.select("regimen_id", "item").join(regimen_sizes(regimens), "regimen_id")
    salts = F.ceil(F.col("n") / limit).cast("int")
    rows = sized.join(attributes, "item").withColumn("salts", salts)
    left = rows.select(
        "regimen_id", "attr", F.col("item").alias("a"), F.pmod(F.xxhash64("item"), F.col("salts")).cast("int").alias("salt")
    )
    right = rows.select(
        "regimen_id", "attr", F.col("item").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    return (
        left.join(right, ["regimen_id", "attr", "salt"])
        .filter(F.col("a") < F.col("b"))
        .select("regimen_id", "a", "b", "attr")
    )


def validation_pairs(interactions: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose pair, in either orientation, has a known reference level.

    ``reference`` has (drug_a, drug_b, level); a pair listed twice keeps its
    most severe level.
    """
    rank = F.when(F.col("level") == "Major", 3).when(F.col("level") == "Moderate", 2).otherwise(1)
    levels = (
        reference.filter(F.col("level") != "Unknown")
        .select(*pair_key(F.lower(F.trim("drug_a")), F.lower(F.trim("drug_b"))), "level", rank.alias("rank"))
        .groupBy("a", "b")
        .agg(F.max_by("level", "rank").alias("reference_level"))
    )
    rows = interactions.select(*pair_key(F.lower(F.trim("drug_name_1")), F.lower(F.trim("drug_name_2"))), "*")
    return rows.join(levels, ["a", "b"])


def contains_pairs(reference: DataFrame, names: DataFrame, rows: DataFrame) -> DataFrame:
    """First row of each reference pair whose names contain the two terms.

    ``reference`` is (ref_id, term1, term2); ``names`` the distinct item names;
    ``rows`` has (name1, name2, ordinal, …).  Terms are matched once against
    the distinct names, not against the rows, then two equi-joins find the rows.
    """
    terms = reference.select(F.explode(F.array(F.lower("term1"), F.lower("term2"))).alias("term")).distinct()
    hits = match_terms(terms, names)
    one = hits.select(F.col("term").alias("term1"), F.col("name").alias("name1"))
    two = hits.select(F.col("term").alias("term2"), F.col("name").alias("name2"))
    pairs = (
        reference.select("ref_id", F.lower("term1").alias("term1"), F.lower("term2").alias("term2"))
        .join(one, "term1")
        .join(two, "term2")
        .select("ref_id", *pair_key(F.col("name1"), F.col("name2")))
        .distinct()
    )
    keyed = rows.select(*pair_key(F.lower("name1"), F.lower("name2")), "*")
    rest = F.struct(*rows.columns)
    return (
        pairs.join(keyed, ["a", "b"])
        .groupBy("ref_id")
        .agg(F.min_by(rest, "ordinal").alias("row"), F.count(F.lit(1)).alias("n_matches"))
        .select("ref_id", "row.*", "n_matches")
    )


def match_terms(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name) where the name contains the term, without a theta join.

    Every name is cut into its substrings of the lengths that occur among the
    terms and met by equality, so both sides hash-partition.  Empty terms match
    nothing.
    """
    # At most as many lengths as the longest term has characters.
    lengths = terms.agg(F.collect_set(F.length("term"))).scalar()
    sized = names.select("name", F.explode(lengths).alias("n")).filter("n between 1 and length(name)")
    cuts = sized.select("name", "n", F.explode(F.expr("sequence(1, length(name) - n + 1)")).alias("at"))
    pieces = cuts.select("name", F.expr("substring(name, at, n)").alias("term")).distinct()
    return pieces.join(terms, "term")


def neighbours(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Partners of each wanted item with severity, mechanism and effect columns."""
    pairs = symmetric(interactions.withColumnsRenamed({"drug_name_1": "a", "drug_name_2": "b"}))
    return pairs.join(items.select("item").distinct(), "item", "left_semi").distinct()
