"""Readers of the interaction table, graph tables and delimited source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from combirisk.schemas import EDGE_KEYS, EDGE_SCHEMAS, INTERACTION_SCHEMA, MODERATE, NODE_SCHEMAS


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system, local or not."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The labelled interaction table; a malformed row fails the read."""
    return spark.read.csv(path, header=True, schema=INTERACTION_SCHEMA, mode="FAILFAST", escape='"', multiLine=False)


def read_nodes(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A node table of the graph export; a missing file is an empty table."""
    schema = NODE_SCHEMAS[kind]
    path = f"{folder}/{kind}.csv"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def named_nodes(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, name): lower-cased name, the id where the name is missing."""
    return nodes.select(F.col(id_col).alias("id"), F.coalesce(F.lower("name"), F.lower(id_col)).alias("name"))


def read_edges(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """An edge table; repeated edges collapse, a missing severity is Moderate."""
    schema = EDGE_SCHEMAS[kind]
    path = f"{folder}/{kind}.csv"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    edges = spark.read.csv(path, header=True, schema=schema, escape='"')
    if "severity" in edges.columns:
        edges = edges.withColumn("severity", F.coalesce("severity", F.lit(MODERATE)))
    return edges.dropDuplicates(EDGE_KEYS[kind]) if kind in EDGE_KEYS else edges


def _raw(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])


def read_side_effects(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated rows with at least six fields: compound, concept, type, name."""
    rows = spark.read.csv(path, sep="\t", schema=_raw(6))
    return rows.filter("c5 is not null").select(
        F.col("c0").alias("compound_id"), F.col("c2").alias("concept"), F.col("c3").alias("kind"), F.col("c5").alias("name")
    )


def read_effect_frequencies(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema=_raw(5))
    return rows.filter("c4 is not null").select(
        F.col("c0").alias("compound_id"), F.col("c2").alias("concept"), F.col("c4").alias("frequency")
    )


def read_chemical_diseases(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows with ``#`` comments; only rows with direct evidence."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=_raw(6))
    return rows.filter("c5 is not null and trim(c5) <> ''").select(
        F.col("c0").alias("source_name"), F.col("c2").alias("cas"), F.col("c3").alias("disease"), F.col("c4").alias("disease_id"), F.col("c5").alias("evidence")
    )


def read_gene_diseases(spark: SparkSession, path: str) -> DataFrame:
    """Header rows with a score column; unreadable scores count 0."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("geneSymbol", "diseaseId", "diseaseName", "score")])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return rows.select(
        F.col("geneSymbol").alias("gene_symbol"), F.col("diseaseId").alias("disease_id"), F.col("diseaseName").alias("disease"),
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
    )


def read_scored_links(spark: SparkSession, path: str, threshold: int) -> DataFrame:
    """(protein1, protein2, score) rows at or above the threshold."""
    rows = spark.read.csv(path, header=True, schema="protein1 string, protein2 string, score int")
    return rows.filter(F.col("score") >= threshold)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="uniprot_id string, go_id string, go_name string, aspect string, evidence string")


def read_reference_levels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="Drug_A string, Drug_B string, Level string")
    return rows.select(F.col("Drug_A").alias("drug_a"), F.col("Drug_B").alias("drug_b"), F.col("Level").alias("level"))


def read_adverse_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="drug1 string, drug2 string, severity string, prr double, event string, source string")


def expert_pairs(rows: DataFrame) -> DataFrame:
    """Curated list without repeated pairs, the earliest entry kept."""
    first = F.min_by(F.struct("severity", "source"), "ordinal").alias("row")
    return rows.groupBy("drug1", "drug2").agg(first, F.min("ordinal").alias("ordinal")).select("drug1", "drug2", "row.*", "ordinal")
