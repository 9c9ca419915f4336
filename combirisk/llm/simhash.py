"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is 64 bits; bit b is set when more than half of the shingle hashes
have it.  Two fingerprints that differ in at most two bits differ in at most two
of their eight bytes, so they share at least six positional bytes (the guaranteed
minimum).  The index has one posting list for each pair of two-byte positions: two
foreign bytes touch at most two of the four positions, so at least one list holds
both.  Inside a list, pairs are tallied by shared positional bytes, kept from six
on, and verified by their differing bits.

Lists above ``list_limit`` members are not paired.  Their members are linked
through midpoints instead: fingerprints at one or two bits' distance have a common
value within one bit of both, and such a value has at most 65 neighbours.  That is
exact too, and its rows grow with the members, not with their square.

Distinct fingerprints enter the index, so exact copies cost one group-by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, table, text_key, utf8
from combirisk.session import cut_lineage

POSITIONS = 4
MINIMUM_SHARED_BYTES = 6
MAXIMUM_BITS = 2
HASH_SEED = 42
# Shingles turned into bits at once (64 bytes each).
BIT_ROWS = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the lower-cased words of one text; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BIT_ROWS):
        part = hashes[start : start + BIT_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        values = np.array([fingerprint(t) for t in utf8(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(values.view(np.int64))], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) for every row; ``key`` tells apart rows of one id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, key long, fp long")


def _postings(fps: DataFrame) -> DataFrame:
    """(place, value, fp): one row for each pair of two-byte positions."""
    shift = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(POSITIONS) for j in range(i + 1, POSITIONS)]
    entries = [F.struct(F.lit(n).alias("place"), (shift(i) * 65536 + shift(j)).alias("value")) for n, (i, j) in enumerate(pairs)]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.place", "e.value", "fp")


def links(fps: DataFrame, list_limit: int = 16) -> DataFrame:
    """(a, b) with a <> b: edges that connect exactly what pairs within two bits connect.

    ``fps`` has distinct fingerprints.  Pairs of short lists come out themselves;
    members of long lists come out linked to the smallest member around a midpoint.
    """
    postings = cut_lineage(_postings(fps))
    sizes = postings.groupBy("place", "value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    short = postings.join(sizes.where(F.col("members") <= list_limit), ["place", "value"])
    other = short.select("place", "value", F.col("fp").alias("other"))
    differing = F.col("fp").bitwiseXOR(F.col("other"))
    shared = sum((F.shiftright(differing, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8))
    tallied = short.join(other, ["place", "value"]).where(F.col("fp") < F.col("other"))
    pairs = tallied.where(shared >= MINIMUM_SHARED_BYTES).where(F.bit_count(differing) <= MAXIMUM_BITS).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    long_members = postings.join(sizes.where(F.col("members") > list_limit), ["place", "value"], "left_semi").select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(v - (1 << 64) if v >> 63 else v)) for v in (1 << b for b in range(64))]
    around = long_members.select("fp", F.explode(F.array(*near)).alias("middle"))
    first = F.min("fp").over(Window.partitionBy("middle"))
    stars = around.select("fp", first.alias("a")).where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each component of ``edges(a, b)``.

    Alternates large-star and small-star steps: every step keeps the components,
    and the edges end as stars around the smallest node.  Each step is two
    shuffles over the edges; the number of steps grows with the logarithm of the
    component size.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = mark(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("b")).where("x <> b").select(F.col("x").alias("a"), "b").distinct()
        edges = cut_lineage(small)
        new = mark(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, component_id, first): the near-duplicate group of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id of the group (null only if all of its ids
    are null); ``first`` is the struct (doc_id, key) of the row that represents it.
    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows come out as often as they come in; further columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs))
    per_fp = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("first")))
    roots = connected(links(per_fp.select("fp")))
    placed = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    of_fp = placed.select("fp", "root").join(groups, "root").select("fp", "component_id", F.struct("first.doc_id", "first.key").alias("first"))
    return rows.join(of_fp, "fp").select("doc_id", "key", "fp", "component_id", "first")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id (ids before null, then by text key)."""
    return keep_rows(docs, near_duplicates(docs).select("first").distinct().select("first.doc_id", "first.key"))


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the given (doc_id, key); of identical ones one stays, the smallest by its other columns."""
    kept = chosen.select(F.col("doc_id").alias("id"), F.col("key").alias("kept"))
    # The row travels as one struct, so no column of it can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("kept")), "left_semi")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("row")))
    return ranked.where("place = 1").select("row.*")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
