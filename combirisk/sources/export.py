"""Writers: graph tables as CSV, records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.operators.network import PRI_WEIGHTS


def write_csv(df: DataFrame, path: str, **options) -> None:
    """One folder of CSV parts; array columns become ``|``-joined text."""
    flat = df.select(
        *[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    )
    flat.write.mode("errorifexists").csv(path, header=options.pop("header", True), escape='"', **options)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Every node, edge and fact table below one folder, named ``<kind>.csv``."""
    for kind, df in tables.items():
        write_csv(df, f"{folder}/{kind}.csv")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def index_decomposition(metrics: DataFrame) -> DataFrame:
    """Weighted parts of the composite index beside the index."""
    parts = [F.round(w * F.col({"degree": "degree_centrality"}.get(c, c)), 6).alias(f"{c}_part") for c, w in PRI_WEIGHTS.items()]
    return metrics.select("item", *parts, F.round("pri", 6).alias("pri"))


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, record) JSON rows: all nodes and all edges."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "kind")).alias("record")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("src", "dst", "kind")).alias("record"))
    )
