"""Line dedup that can be taken back: exact reference counts behind sharded cuckoo filters.

A line's key is the line without white space at its ends and with A-Z in lower case,
held as the 128-bit BLAKE2b digest of its bytes.  The index has two tables in the
shared folder.  ``references`` counts the documents that hold each key; inserting
and deleting documents adds and subtracts, so any sequence of both leaves what the
documents now in the index give.  ``filters`` has one cuckoo filter for each shard
of keys, with the keys that at least ``threshold`` documents hold; a key enters when
its count rises to the threshold and is deleted when it falls below.

Cleaning looks every line up in the filters, which go to the tasks in groups of
bounded size; no line is shuffled.  A filter may take a foreign key for one of its
own (about 2 in a thousand million).  Such keys of the index are found by looking
all counted keys up once, and lie beside their shard's filter as exceptions, so
the result is exact for documents of the index.

Counts are summed within each task before they are shuffled; a line that a third of
all documents share is one row a task.  Updates make new tables and leave the old
ones, so a lost task or a stopped job never leaves half an update.

Defined results: null and empty texts are one empty line; empty keys are never
dropped; every row is a document, repeated rows and ids included; further columns
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from combirisk.llm.common import BLOCK_BYTES, blocks, stored, table, utf8

# Keys that one shard's filter should hold at most; more keys make more shards.
SHARD_KEYS = 1 << 20
# Bytes of filters that one pass over the documents takes along.
GROUP_BYTES = 64 << 20
# Bytes of keys that a task counts before it gives its counts out.
COUNT_BYTES = 32 << 20
SLOTS = 4
FULLEST, FRESH_LOAD, EMPTIEST = 0.8, 0.6, 0.05
ROUNDS = 500


class CuckooFilter:
    """32-bit marks of distinct 128-bit keys in buckets of four; what finds no place after ``ROUNDS`` moves is kept aside."""

    def __init__(self, slots: np.ndarray, aside: np.ndarray | None = None) -> None:
        self.slots = slots
        self.aside = np.zeros((0, 2), np.uint32) if aside is None else aside

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * FRESH_LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = keys.view(np.uint64)
        marks = (words[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        marks[marks == 0] = 1
        return marks, (words[:, 1] >> np.uint64(32)).astype(np.uint32) & np.uint32(len(self.slots) - 1)

    def _other(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        mixed = (marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return at ^ (mixed.astype(np.uint32) & np.uint32(len(self.slots) - 1))

    def add(self, keys: np.ndarray) -> None:
        """Insert distinct keys (n, 2) that are not in the filter."""
        draw = np.random.default_rng(len(keys))
        marks, at = self._places(keys)
        for step in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            marks, at = marks[order], at[order]
            first = np.searchsorted(at, at)
            rank = np.arange(len(at)) - first
            taken = self.slots[at] != 0
            free = SLOTS - taken.sum(axis=1)
            fits = rank < free
            where = np.argsort(taken, axis=1, kind="stable")
            self.slots[at[fits], where[fits, rank[fits]]] = marks[fits]
            marks, at = marks[~fits], at[~fits]
            if not len(at):
                return
            if step:
                # One of each full bucket changes places with an entry that lies there.
                leading = np.unique(at, return_index=True)[1]
                slot = draw.integers(SLOTS, size=len(leading))
                out = self.slots[at[leading], slot].copy()
                self.slots[at[leading], slot] = marks[leading]
                marks[leading] = out
            at = self._other(marks, at)
        self.aside = np.concatenate([self.aside, np.stack([marks, at], axis=1)])

    def remove(self, keys: np.ndarray) -> None:
        """Delete distinct keys that are in the filter; of entries that look alike one goes for each."""
        marks, at = self._places(keys)
        pending = np.arange(len(marks))
        while len(pending):
            m, a = marks[pending], at[pending]
            here = self.slots[a] == m[:, None]
            b = np.where(here.any(axis=1), a, self._other(m, a))
            there = self.slots[b] == m[:, None]
            found = there.any(axis=1)
            flat = b.astype(np.int64) * SLOTS + there.argmax(axis=1)
            once = np.unique(np.where(found, flat, -1 - np.arange(len(flat))), return_index=True)[1]
            go = once[found[once]]
            self.slots.reshape(-1)[flat[go]] = 0
            for i in np.flatnonzero(~found):
                both = (self.aside[:, 0] == m[i]) & ((self.aside[:, 1] == a[i]) | (self.aside[:, 1] == self._other(m[i : i + 1], a[i : i + 1])[0]))
                if not both.any():
                    raise ValueError("a key to delete is not in the filter")
                self.aside = np.delete(self.aside, int(both.argmax()), axis=0)
            left = found.copy()
            left[go] = False
            pending = pending[left]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        marks, at = self._places(keys)
        other = self._other(marks, at)
        found = (self.slots[at] == marks[:, None]).any(axis=1) | (self.slots[other] == marks[:, None]).any(axis=1)
        for mark, place in self.aside:
            found |= (marks == mark) & ((at == place) | (other == place))
        return found


def line_keys(text: bytes) -> list[bytes]:
    """Key of every line, in order."""
    return [line.strip() for line in text.lower().split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) of 64-bit halves."""
    return np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), "<i8").reshape(-1, 2)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each key, summed over what a task can hold."""
    counts: Counter[bytes] = Counter()
    held = 0

    def out() -> pa.RecordBatch:
        made = digests(list(counts))
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(list(counts.values()), pa.int64())], ["hi", "lo", "docs"])

    for batch in blocks(batches, "text"):
        for text in utf8(batch.column("text")):
            keys = set(line_keys(text))
            keys.discard(b"")
            counts.update(keys)
            held += len(text)
        if held >= COUNT_BYTES:
            yield out()
            counts.clear()
            held = 0
    yield out()


def line_counts(docs: DataFrame) -> DataFrame:
    """(hi, lo, docs): the number of rows of ``docs(text)`` that hold each key."""
    return docs.select("text").mapInArrow(_counted, "hi long, lo long, docs long").groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


FILTERS = "shard long, slots binary, aside binary"


def _changed(old: pd.DataFrame, feed: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its changes, or made anew."""
    if len(feed):
        keys = feed[["hi", "lo"]].to_numpy(np.int64)
        enters = feed["enters"].to_numpy(bool)
        shard = int(feed["shard"].iloc[0])
        if feed["anew"].iloc[0]:
            made = CuckooFilter.sized(len(keys))
        else:
            made = _filter(old["slots"].iloc[0], old["aside"].iloc[0])
        # Deletions first: they make room.
        made.remove(keys[~enters])
        made.add(keys[enters])
        return pd.DataFrame({"shard": [shard], "slots": [made.slots.tobytes()], "aside": [made.aside.tobytes()]})
    return old[["shard", "slots", "aside"]]


def _filter(slots: bytes, aside: bytes) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(slots, np.uint32).reshape(-1, SLOTS).copy(), np.frombuffer(aside, np.uint32).reshape(-1, 2).copy())


class _Group:
    """Some shards' filters with their exceptions, opened by a task from the plain values that travelled to it."""

    def __init__(self, shards: int, rows: list[tuple]) -> None:
        self.shards = shards
        self.open = {s: (_filter(slots, aside), set(exceptions)) for s, slots, aside, exceptions in rows}

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        # Python's and Spark's pmod agree for a positive divisor.
        shard = keys[:, 0] % self.shards
        for s in np.unique(shard):
            if int(s) in self.open:
                own, exceptions = self.open[int(s)]
                mine = np.flatnonzero(shard == s)
                found[mine] = own.holds(np.ascontiguousarray(keys[mine]))
                if exceptions:
                    for i in mine[found[mine]]:
                        found[i] = tuple(keys[i].tolist()) not in exceptions
        return found


def _probed(batches: Iterator[pa.RecordBatch], group) -> Iterator[pa.RecordBatch]:
    """Keys that the filters take for one of theirs."""
    opened = _Group(*group.value)
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy() for n in ("hi", "lo")], axis=1)
        yield batch.filter(pa.array(opened.holds(keys)))


def _lined(batches: Iterator[pa.RecordBatch], group) -> Iterator[pa.RecordBatch]:
    """Add the lines whose keys a group of filters holds to ``gone``."""
    opened = _Group(*group.value)
    for batch in blocks(batches, "text"):
        lined = [line_keys(t) for t in utf8(batch.column("text"))]
        distinct = list({k for keys in lined for k in keys if k})
        held = opened.holds(digests(distinct)) if distinct else []
        drop = {k for k, h in zip(distinct, held) if h}
        gone = [(before or []) + [i for i, k in enumerate(keys) if k in drop] for before, keys in zip(batch.column("gone").to_pylist(), lined)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(gone, pa.list_(pa.int32()))], ["row", "text", "gone"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of every text."""
    for batch in blocks(batches, "text"):
        kept, lines, dropped = [], [], []
        for text, gone in zip(utf8(batch.column("text")), batch.column("gone").to_pylist()):
            parts, away = text.split(b"\n"), set(gone or [])
            kept.append(b"\n".join(p for i, p in enumerate(parts) if i not in away) if away else text)
            lines.append(len(parts))
            dropped.append(len(away))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])


@dataclass(frozen=True)
class LineIndex:
    """Reference counts and filters of the documents inserted so far; every update gives a new index."""

    spark: SparkSession
    threshold: int = 10
    shards: int = 1
    references: DataFrame | None = None
    filters: DataFrame | None = None

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the rows of ``docs(text)`` added."""
        return self._updated(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the rows of ``docs(text)``; they must have been inserted."""
        return self._updated(docs, -1)

    def clean(self, docs: DataFrame) -> DataFrame:
        """(row, kept, n_lines, n_dropped) for every row of ``docs``, which the index must hold; ``row`` has its columns but text."""
        others = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
        found = docs.select(F.struct(*others).alias("row"), "text", F.lit(None).cast("array<int>").alias("gone"))
        schema = found.schema
        for i, group in enumerate(self._groups()):
            if i:
                # Each pass holds one group of filters only.
                found = stored(found, "lines")
            shared = self.spark.sparkContext.broadcast(group)
            found = found.mapInArrow(lambda b, g=shared: _lined(b, g), schema)
        row = schema["row"].dataType.simpleString()
        return found.mapInArrow(_joined, f"row {row}, kept string, n_lines long, n_dropped long")

    def _shard(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.shards))

    def _updated(self, docs: DataFrame, sign: int) -> LineIndex:
        counted = line_counts(docs).select("hi", "lo", (F.col("docs") * sign).alias("docs"), F.lit(0).cast("long").alias("before"))
        if self.references is not None:
            counted = self.references.where("docs > 0").select("hi", "lo", "docs", F.col("docs").alias("before")).unionByName(counted).groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.sum("before").alias("before"))
        references = stored(counted, "line-references")
        enough = F.col("docs") >= self.threshold
        facts = references.agg(F.min("docs").alias("least"), F.count(F.when(enough, True)).alias("held")).first()
        if (facts["least"] or 0) < 0:
            raise ValueError("documents to delete were not in the index")
        new = replace(self, references=references)
        if self.filters is None or facts["held"] > self.shards * SHARD_KEYS:
            new = replace(new, shards=max(1, -(-2 * facts["held"] // SHARD_KEYS)), filters=None)
        return new._filtered()

    def _filtered(self) -> LineIndex:
        """Bring the filters up to the reference counts."""
        enough = F.col("docs") >= self.threshold
        held = self.references.where(enough).select(self._shard().alias("shard"), "hi", "lo", F.lit(True).alias("enters"))
        if self.filters is None:
            old = self.spark.createDataFrame([], FILTERS)
            feed = held.withColumn("anew", F.lit(True))
        else:
            old = self.filters.select("shard", "slots", "aside")
            crossed = self.references.where(enough != (F.col("before") >= self.threshold)).select(self._shard().alias("shard"), "hi", "lo", enough.alias("enters"))
            # Filters that would be too full, or nearly empty, are made anew from the counts.
            room = old.select("shard", (F.length("slots") / 4).alias("room"))
            fill = held.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).join(room, "shard", "full")
            fits = (F.col("n") <= F.col("room") * FULLEST) & ((F.col("n") >= F.col("room") * EMPTIEST) | (F.col("room") <= 1024))
            fill = fill.select("shard", (~F.coalesce(fits, F.col("n").isNull())).alias("anew"))
            feed = crossed.join(fill.where("not anew"), "shard").unionByName(held.join(fill.where("anew"), "shard"))
        made = old.groupBy("shard").cogroup(feed.groupBy("shard")).applyInPandas(_changed, FILTERS)
        bare = replace(self, filters=stored(made.withColumn("exceptions", F.lit(None).cast("array<struct<hi:long,lo:long>>")), "line-filters"))
        taken = [self.references.where(~enough & (F.col("docs") > 0)).select("hi", "lo").mapInArrow(lambda b, g=self.spark.sparkContext.broadcast(group): _probed(b, g), "hi long, lo long") for group in bare._groups()]
        if not taken:
            return bare
        wrong = taken[0]
        for t in taken[1:]:
            wrong = wrong.unionByName(t)
        listed = wrong.groupBy(self._shard().alias("shard")).agg(F.collect_list(F.struct("hi", "lo")).alias("exceptions"))
        return replace(bare, filters=stored(bare.filters.drop("exceptions").join(listed, "shard", "left"), "line-filters"))

    def _groups(self) -> list[tuple[int, list[tuple]]]:
        """The filters in groups of at most ``GROUP_BYTES`` (or one shard), each small enough for one task."""
        sizes = sorted((r["shard"], r["size"]) for r in self.filters.select("shard", (F.length("slots") + F.length("aside")).alias("size")).collect())
        groups: list[list[int]] = []
        room = 0
        for shard, size in sizes:
            if not groups or size > room:
                groups.append([])
                room = GROUP_BYTES
            groups[-1].append(shard)
            room -= size
        plain = lambda r: (r["shard"], bytes(r["slots"]), bytes(r["aside"]), [tuple(e) for e in r["exceptions"] or []])
        return [(self.shards, [plain(r) for r in self.filters.where(F.col("shard").isin(g)).collect()]) for g in groups]


def drop_shared_lines(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """``docs`` without the lines that at least ``threshold`` of its rows share; null texts come out as empty."""
    found = LineIndex(docs.sparkSession, threshold).insert(docs).clean(docs)
    return found.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = LineIndex(spark).insert(docs).clean(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_SPACE = r"[\x20\x09-\x0D]"
OP12_SQL = rf"""
with docs as (select row_number() over () as n, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select n, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from docs),
keyed as (
  select *, translate(regexp_replace(line, '\A{_SPACE}+|{_SPACE}+\z', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key from keyed where key <> '' group by key having count(distinct n) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(s.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where s.key is null), '')) as kept_sha256
from keyed k left join shared s on s.key = k.key group by n
"""
