"""Near copies at a 5-word similarity of 0.8, beside the SimHash links: positional bytes, tally, verification on texts.

Two texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 differ in
about 15 % of SimHash bits, far beyond a radius that leaves posting lists short.
So the positional bytes come from minima here: byte i of a text is one byte of the
least of its shingle hashes under the i-th multiplier, and two texts share each
byte with a probability of their similarity (and 1/256 by chance).  The inverted
index has one list for each ``GROUP`` bytes side by side; texts of similarity 0.8
meet in at least one of ``GROUPS`` lists with a probability of 0.99.  Every pair of a
list is verified on the shingle sets of its whole texts; nothing is dropped before.

In lists of more than ``PAIRED`` members all meet the first one, and what those links
and the short lists connect needs no more pairs.  The members that they leave outside
the first one's component meet all members of the list, in tiles of ``TILE`` by ``TILE``,
so that a large group of near copies costs rows in proportion to its members and no
link between different components is lost.  Texts with the same shingles enter the index once.

Links of near copies and of fingerprints (``simhash``) make the groups together.

Defined results: null, empty and blank texts have no shingle and are linked by
their fingerprint only; texts of fewer than five words are one shingle; repeated
rows and ids are rows of their own; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm import simhash
from combirisk.llm.common import blocks, stored, text_key, utf8

WIDTH, SIMILARITY = 5, 0.8
GROUP, GROUPS = 5, 12
PAIRED = 32
# Members of a long list that one side of a comparison holds.
TILE = 256
# Shingles that meet all multipliers at once.
SHINGLES = 4096
_DRAW = np.random.default_rng(7)
MULTIPLIERS = _DRAW.integers(1, 1 << 63, GROUP * GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 1 << 63, GROUP * GROUPS, dtype=np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, simhash.HASH_SEED) for s in shingles), dtype=np.uint64))


def positional_bytes(hashes: np.ndarray) -> bytes:
    """One byte for each multiplier; none without a shingle."""
    if not len(hashes):
        return b""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), SHINGLES):
        mixed = hashes[None, start : start + SHINGLES] * MULTIPLIERS[:, None] + SHIFTS[:, None]
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        hashes = [shingle_hashes(t) for t in utf8(batch.column("text"))]
        nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), simhash.HASH_SEED) for h in hashes], np.uint64).view(np.int64)
        made = [positional_bytes(h) for h in hashes]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(nodes), pa.array(made, pa.binary())], ["doc_id", "key", "node", "marks"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        made = [np.unique(shingle_hashes(t).astype(np.uint32)).tobytes() for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for one, two in zip(*(batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b"))):
            x, y = np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(both >= similarity * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _compared(left: pa.Table, right: pa.Table, similarity: float) -> pa.Table:
    """(a, b) of every similar pair between two tiles of (node, shingles)."""
    ours, theirs = (t.column("node").to_numpy() for t in (left, right))
    sets = [np.frombuffer(v, np.uint32) for v in right.column("shingles").to_pylist()] if left.num_rows else []
    found_a, found_b = [ours[:0]], [ours[:0]]
    if sets:
        sizes = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
        for node, value in zip(ours, left.column("shingles").to_pylist()):
            mine = np.frombuffer(value, np.uint32)
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
            near = theirs[(both >= similarity * (len(mine) + sizes - both)) & (theirs != node)]
            found_a.append(np.minimum(near, node))
            found_b.append(np.maximum(near, node))
    return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def _lists(nodes: DataFrame) -> DataFrame:
    """(place, value, node, members, first): the index entries of lists with two members or more."""
    value = lambda g: F.conv(F.hex(F.substring("marks", GROUP * g + 1, GROUP)), 16, 10).cast("long")
    entries = F.explode(F.array(*[F.struct(F.lit(g).alias("place"), value(g).alias("value")) for g in range(GROUPS)])).alias("e")
    postings = nodes.filter(F.length("marks") > 0).select("node", entries).select("e.place", "e.value", "node")
    lists = postings.groupBy("place", "value").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")).filter("members > 1")
    return stored(postings.join(lists, ["place", "value"]), "near-postings")


def _candidates(sized: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of the short lists; members of long lists with the first of the list."""
    short = sized.filter(F.col("members") <= PAIRED).select("place", "value", F.col("node").alias("a"))
    pairs = short.join(short.withColumnRenamed("a", "b"), ["place", "value"]).filter("a < b").select("a", "b")
    stars = sized.filter(F.col("members") > PAIRED).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(stars).distinct()


def _rest_links(sized: DataFrame, sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame | None:
    """Similar pairs of long lists with a member outside the component of the first of the list; None if there is no such member."""
    longer = sized.filter(F.col("members") > PAIRED)
    roots = simhash.connected(links)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = F.coalesce("root_node", "node") != F.coalesce("root_first", "first")
    rest = stored(longer.join(root("node"), "node", "left").join(root("first"), "first", "left").filter(apart).select("place", "value", "node"), "near-rest")
    if rest.isEmpty():
        return None
    key = ["place", "value"]
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    counts = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rest")).join(longer.select(*key, "members").distinct(), key).select(*key, tiles("n_rest").alias("n_left"), tiles("members").alias("n_right"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A side goes to each tile of the other one; sets join last, so that nothing else carries them.
    left = rest.join(counts, key).select(*key, "node", own("n_left").alias("l"), other("n_right").alias("r")).join(sets, "node")
    right = longer.select(*key, "node").join(counts, key).select(*key, "node", own("n_right").alias("r"), other("n_left").alias("l")).join(sets, "node")
    by = [*key, "l", "r"]
    # Both sides come from the same tables; new columns keep them apart.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda x, y: _compared(x, y, similarity), "a long, b long").distinct()


def _ends(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Add ``column`` of both nodes of every pair."""
    for end in "ab":
        pairs = pairs.join(df.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def near_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(key, node) of every distinct text of ``docs(doc_id, text)``, and verified links (a, b) between nodes."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text_key("text").alias("key"), "text")
    rows = stored(keyed.mapInArrow(_marked, "doc_id long, key long, node long, marks binary"), "near-marks")
    nodes = stored(rows.groupBy("node").agg(F.first("marks").alias("marks"), F.min(F.struct("key", "doc_id")).alias("row")), "near-nodes")
    sized = _lists(nodes)
    pairs = stored(_candidates(sized), "near-pairs")
    # One text of each node that stands in a list; equal keys are equal texts.
    needed = sized.select("node").distinct().join(nodes.select("node", "row.key", "row.doc_id"), "node")
    texts = keyed.join(needed, ["key", "doc_id"]).select("node", "text")
    sets = stored(texts.mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "near-sets")
    links = stored(_ends(sets, "shingles", pairs).mapInArrow(lambda b: _verified(b, similarity), "a long, b long"), "near-links")
    # Long lists are found by their first entries; without any, all pairs have been seen.
    if not sized.filter(F.col("members") > PAIRED).isEmpty():
        more = _rest_links(sized, sets, links, similarity)
        links = links if more is None else links.unionByName(more).distinct()
    return rows.select("key", "node").distinct(), links


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key): the first row of every group of ``docs``, by fingerprint links and near copies together."""
    found = stored(simhash.near_duplicates(docs).select("key", "first").distinct(), "near-groups")
    keys, links = near_links(docs, similarity)
    group = F.xxhash64(F.lit("group"), "first").alias("group")
    node = lambda c: F.xxhash64(F.lit("node"), c)
    # A distinct text lies in one fingerprint group and in one node.
    owned = found.select("key", group).join(keys, "key").select(F.col("group").alias("a"), node("node").alias("b")).distinct()
    roots = simhash.connected(owned.unionByName(links.select(node("a").alias("a"), node("b").alias("b"))))
    groups = found.select(group, "first").distinct().join(roots.withColumnRenamed("node", "group"), "group", "left")
    least = F.min(F.struct(F.isnull("first.doc_id").alias("no_id"), F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"))).alias("least")
    return groups.groupBy(F.coalesce("root", "group").alias("root")).agg(least).select("least.doc_id", "least.key")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (ids before null, then by text key)."""
    return simhash.keep_rows(docs, representatives(docs, similarity))
