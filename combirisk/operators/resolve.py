"""Resolving names, ids and free text to items, and matching source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.functions.names import edit_ratio, name_similarity
from combirisk.operators.pairs import match_terms, pair_key


def resolve_names(inputs: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(input, item, method): id, then alias, then exact name, then containment.

    ``inputs(input)``, ``items(drug_id, item)``, ``aliases(alias, name)``.  Only
    inputs that no equi-join resolves reach the containment step; its winner is
    the shortest name, then the first by name.
    """
    wanted = inputs.select("input").distinct()
    by_id = wanted.join(items.select(F.col("drug_id").alias("input"), F.col("item").alias("id_item")), "input", "left")
    lowered = by_id.withColumn("key", F.lower(F.trim("input")))
    aliased = lowered.join(
        aliases.select(F.col("alias").alias("key"), F.col("name").alias("alias_name")), "key", "left"
    ).withColumn("name", F.coalesce("alias_name", "key"))
    exact = aliased.join(items.select(F.col("item").alias("name"), F.col("item").alias("name_item")), "name", "left")
    found = exact.select(
        "input",
        "name",
        F.coalesce("id_item", "name_item").alias("item"),
        F.when(F.col("id_item").isNotNull(), "id")
        .when(F.col("name_item").isNotNull() & F.col("alias_name").isNotNull(), "alias")
        .when(F.col("name_item").isNotNull(), "name")
        .alias("method"),
    )
    open_names = found.filter("item is null").select(F.col("name").alias("term")).distinct()
    partial = (
        contains_either(open_names, items.select(F.col("item").alias("name")))
        .groupBy("term")
        .agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("best"))
        .select(F.col("term").alias("name"), F.col("best.name").alias("partial"))
    )
    return found.join(partial, "name", "left").select(
        "input",
        F.coalesce("item", "partial").alias("item"),
        F.coalesce("method", F.when(F.col("partial").isNotNull(), "contains"), F.lit("unresolved")).alias("method"),
    )


def contains_either(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name) where one is a substring of the other, by equality of pieces."""
    inside = match_terms(terms, names).select("term", "name")
    outside = match_terms(
        names.select(F.col("name").alias("term")), terms.select(F.col("term").alias("name"))
    ).select(F.col("name").alias("term"), F.col("term").alias("name"))
    return inside.unionByName(outside).distinct()


def _grams(c: Column) -> Column:
    """Blocking keys: character pairs, and single characters of strings up to 5 long."""
    two = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.concat(F.lit("2"), c.substr(i, F.lit(2)))
    )
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.lit("1"), c.substr(i, F.lit(1))))
    return F.array_distinct(F.when(F.length(c) <= 5, F.concat(two, one)).otherwise(two))


def fuzzy_matches(queries: DataFrame, names: DataFrame, threshold: float = 0.6, k: int = 5) -> DataFrame:
    """(query, name, ratio, rank, status): the k closest names above the threshold.

    With a ratio of at least 0.6 two strings of which one is longer than 5
    characters share a pair of neighbouring characters, and shorter ones share
    a character, so joining on these grams misses nothing.
    """
    if threshold < 0.6:
        raise ValueError("the gram blocking is exact for thresholds of 0.6 and above")
    q = queries.select("query").distinct().select("query", F.explode(_grams(F.col("query"))).alias("gram"))
    n = names.select("name").distinct().select("name", F.explode(_grams(F.col("name"))).alias("gram"))
    long = F.greatest(F.length("query"), F.length("name"))
    short = F.least(F.length("query"), F.length("name"))
    pairs = q.join(n, "gram").filter(short >= threshold * long).select("query", "name").distinct()
    scored = pairs.select("query", "name", F.round(edit_ratio("query", "name"), 6).alias("ratio")).filter(F.col("ratio") >= threshold)
    w = Window.partitionBy("query").orderBy(F.desc("ratio"), F.asc("name"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    status = F.when(F.col("ratio") >= 0.95, "accepted").otherwise("suggested")
    return ranked.select("query", "name", "ratio", "rank", status.alias("status"))


def synonym_match(items: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows whose name is the item's name or one of its synonyms.

    ``items(drug_id, name, synonyms)``, ``source(source_name, …)``; distinct matches.
    """
    keys = items.select(
        "drug_id", F.explode(F.array_distinct(F.concat(F.array("name"), "synonyms"))).alias("key")
    ).select("drug_id", F.lower(F.trim("key")).alias("key")).distinct()
    return source.withColumn("key", F.lower(F.trim("source_name"))).join(keys, "key").drop("key").distinct()


def prioritised_match(items: DataFrame, source: DataFrame) -> DataFrame:
    """Match by registry number, else by name; match_type and match_value recorded.

    ``items(drug_id, name, cas)``, ``source(source_name, cas, …)``.
    """
    by_cas = items.filter("cas is not null").select("cas", F.col("drug_id").alias("cas_id"))
    by_name = items.select(F.lower("name").alias("key"), F.col("drug_id").alias("name_id"))
    rows = source.withColumn("key", F.lower("source_name")).join(by_cas, "cas", "left").join(by_name, "key", "left")
    matched = F.coalesce("cas_id", "name_id")
    return (
        rows.filter(matched.isNotNull())
        .withColumn("drug_id", matched)
        .withColumn("match_type", F.when(F.col("cas_id").isNotNull(), "CAS").otherwise("name"))
        .withColumn("match_value", F.when(F.col("cas_id").isNotNull(), F.col("cas")).otherwise(F.col("source_name")))
        .drop("key", "cas_id", "name_id")
    )


def padded_id(number: str | Column) -> Column:
    c = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("CID1"), F.lpad(c.cast("string"), 8, "0"))


def padded_id_match(items: DataFrame, source: DataFrame) -> DataFrame:
    """Join source compound ids ``CID1########`` to items(drug_id, cid)."""
    keyed = items.filter("cid is not null").select("drug_id", padded_id("cid").alias("compound_id"))
    return source.join(keyed, "compound_id")


def update_frequencies(edges: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("item", "attr")) -> DataFrame:
    """Set frequency on existing (item, attr) edges; the last update of an edge wins.

    An update may speak for all edges with the same ``keys``: the last one of each key is
    found before it meets the edges.
    """
    latest = updates.groupBy(*keys).agg(F.max_by("frequency", "ordinal").alias("new_frequency"))
    return edges.join(latest, list(keys), "left").select(
        *[c for c in edges.columns if c != "frequency"], F.coalesce("new_frequency", "frequency").alias("frequency")
    )


def gene_associations(proteins: DataFrame, associations: DataFrame) -> DataFrame:
    """Protein-disease rows over the upper-cased gene symbol."""
    left = proteins.select("protein_id", F.upper("gene_name").alias("gene"))
    return left.join(associations.withColumn("gene", F.upper("gene_symbol")).drop("gene_symbol"), "gene")


def protein_links(links: DataFrame, proteins: DataFrame, threshold: int = 400) -> DataFrame:
    """Protein-protein edges above the score with both ends known."""
    one = proteins.select(F.col("uniprot_id").alias("protein1"), F.col("protein_id").alias("src"))
    two = proteins.select(F.col("uniprot_id").alias("protein2"), F.col("protein_id").alias("dst"))
    return links.filter(F.col("score") >= threshold).join(one, "protein1").join(two, "protein2").select("src", "dst", "score")


def aspect_namespace(aspect: Column) -> Column:
    # Ontology aspects.
    return F.when(aspect == "F", "molecular_function").when(aspect == "P", "biological_process").when(aspect == "C", "cellular_component")


def synonym_matches(names: DataFrame, experts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, expert, score): both names of one id 0.98, else the expert's name among all names of the name's id 0.95.

    ``synonyms(id, name)`` lists every name of every id; a name of several ids stands for the smallest.
    """
    listed = synonyms.select("id", F.lower(F.trim("name")).alias("name")).distinct()
    own = listed.groupBy("name").agg(F.min("id").alias("id"))
    known = names.join(own, "name").select("name", "id")
    direct = known.join(own.select(F.col("name").alias("expert"), "id"), "id").join(experts, "expert", "left_semi").select("name", "expert", F.lit(0.98).alias("score"))
    other = known.join(listed.select("id", F.col("name").alias("expert")), "id").join(experts, "expert", "left_semi").select("name", "expert", F.lit(0.95).alias("score"))
    return direct.unionByName(other).groupBy("name", "expert").agg(F.max("score").alias("score"))


def fuzzy_name_matches(names: DataFrame, experts: DataFrame, threshold: float = 0.85, synonyms: DataFrame | None = None) -> DataFrame:
    """(name, expert, score): equal 1.0, one inside the other 0.95, then by ``synonyms``, then similar by ratio.

    A similarity of 0.85 needs at least three equal leading characters (the
    other two parts reach .7 together), so the ratio step joins on them.
    """
    if threshold < 0.85:
        raise ValueError("the prefix join is exact for thresholds of 0.85 and above")
    n = names.select(F.lower(F.trim("name")).alias("name")).distinct()
    e = experts.select(F.lower(F.trim("expert")).alias("expert")).distinct()
    inside = contains_either(e.select(F.col("expert").alias("term")), n).select(
        "name", F.col("term").alias("expert"), F.when(F.col("name") == F.col("term"), 1.0).otherwise(0.95).alias("score")
    )
    similar = (
        n.withColumn("p", F.substring("name", 1, 3))
        .join(e.withColumn("p", F.substring("expert", 1, 3)), "p")
        .select("name", "expert", F.round(name_similarity("name", "expert"), 6).alias("score"))
        .filter(F.col("score") >= threshold)
    )
    both = inside.withColumn("tier", F.lit(2)).unionByName(similar.withColumn("tier", F.lit(0)))
    if synonyms is not None:
        both = both.unionByName(synonym_matches(n, e, synonyms).withColumn("tier", F.lit(1)))
    return both.groupBy("name", "expert").agg(F.max_by("score", "tier").alias("score"))


def best_expert_pair(pairs: DataFrame, experts: DataFrame, threshold: float = 0.85, floor: float = 0.8, synonyms: DataFrame | None = None) -> DataFrame:
    """Best expert entry of each pair(a, b): mean name score, either orientation.

    ``experts(drug1, drug2, severity, source, ordinal)``; ties go to the
    earlier entry.
    """
    names = pairs.select(F.explode(F.array("a", "b")).alias("name"))
    known = experts.select(F.explode(F.array("drug1", "drug2")).alias("expert"))
    matches = fuzzy_name_matches(names, known, threshold, synonyms)
    one = matches.select(F.col("name").alias("a"), F.col("expert").alias("e1"), F.col("score").alias("s1"))
    two = matches.select(F.col("name").alias("b"), F.col("expert").alias("e2"), F.col("score").alias("s2"))
    listed = experts.select(*[c.alias(n) for c, n in zip(pair_key(F.lower("drug1"), F.lower("drug2")), ("x", "y"))], "severity", "source", "ordinal")
    scored = (
        pairs.select("a", "b").distinct()
        .join(one, "a")
        .join(two, "b")
        .withColumn("x", F.least("e1", "e2"))
        .withColumn("y", F.greatest("e1", "e2"))
        .join(listed, ["x", "y"])
        .withColumn("match_score", (F.col("s1") + F.col("s2")) / 2)
        .filter(F.col("match_score") > floor)
    )
    best = F.max_by(F.struct("x", "y", "severity", "source"), F.struct("match_score", (-F.col("ordinal")).alias("o")))
    return scored.groupBy("a", "b").agg(best.alias("e"), F.max("match_score").alias("match_score")).select(
        "a", "b", F.col("e.x").alias("expert_1"), F.col("e.y").alias("expert_2"),
        F.col("e.severity").alias("expert_severity"), F.col("e.source").alias("source"), "match_score",
    )


def entity_mentions(texts: DataFrame, terms: DataFrame, max_words: int = 2) -> DataFrame:
    """(text_id, item): dictionary terms found as whole words.

    Texts become word n-grams that meet the dictionary by equality: the cost
    follows the text, not text times dictionary.  ``terms(term, item)``.
    """
    # n-grams never span punctuation, so the text is cut into runs of words first.
    runs = texts.select("text_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_ -]+")).alias("run")).select(
        "text_id", F.filter(F.split("run", r"[ -]+"), lambda w: w != "").alias("w")
    )

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, joined).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in range(1, max_words + 1)]
    exploded = runs.filter(F.size("w") > 0).select("text_id", F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("term"))
    return exploded.join(terms.select("term", "item").distinct(), "term").select("text_id", "item").distinct()


def referential(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose two endpoints exist."""
    known = nodes.select("id").distinct()
    return edges.join(known.withColumnRenamed("id", src), src, "left_semi").join(known.withColumnRenamed("id", dst), dst, "left_semi")
