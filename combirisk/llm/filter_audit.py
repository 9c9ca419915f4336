"""Filter interaction audit: what every order of the filters removes, with exact duplicates found by radix tries.

Four filters look at one text.  The fifth asks whether a smaller doc_id has the very
same text.  For it, texts are dealt over ranges of text prefixes and each range
inserts its whole texts into a compressed trie, whose terminals hold the smallest id
and the rows that end there; a walk over the terminals flags every row with a larger
id.  The rows' failures are five bits, and counts of (part, bits, labels) are all
that the audit of 120 orders needs.

Prefixes are adaptive.  All texts are counted by prefixes of several lengths; those
that outweigh a range are counted again from there on, the texts under a longer one
apart from the rest of a shorter one, so the common start of many near copies is
passed in long steps.  A prefix of only one text cannot be cut; it is dealt over
several tasks by id, each finds its own smallest id, and those meet in a second,
small trie.

Before the texts move, each task inserts them into tries of its own and sends one
row for each different text, so a text that a third of all documents share moves
once for each such trie.

Defined results: null texts are empty; null sources are the empty string; rows
without doc_id never fail as duplicates and make none; equal rows with one doc_id
are no duplicates of each other; every row counts; a document has a label if any of
its label rows says so; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, stored, table, utf8

FILTERS = "ABCDE"
FEW_WORDS, COMMON_SHARE, CAPITAL_SHARE = 200, 50, 2
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
# Bytes of text that one range, and one task's own trie, should hold.
RANGE_BYTES = 32 << 20
# Bytes by which a prefix grows: the least step cuts, the longer ones pass what many texts share.
STEPS = (2, 4, 8, 16, 64, 256, 1024)
# What a row weighs beside its text, and a byte that no text has: behind a text it keeps the whole text apart from longer ones.
ROW_WEIGHT, LAST = 64, b"\xff"


class Node:
    __slots__ = ("label", "children", "least", "rows")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.least, self.rows = label, {}, None, []


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


class Trie:
    """Compressed trie over bytes; a terminal holds the least id and the rows of its text."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes, ident: int, row: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at
            elif not text.startswith(child.label, at):
                same = shared_length(child.label, text[at : at + len(child.label)])
                middle = node.children[text[at]] = Node(child.label[:same])
                child.label = child.label[same:]
                middle.children[child.label[0]] = child
                child = middle
            node, at = child, at + len(child.label)
        node.least = ident if node.least is None else min(node.least, ident)
        node.rows.append((row, ident))

    def larger(self) -> Iterator[int]:
        """Rows whose id is not the least of their text."""
        pending = [self.root]
        while pending:
            node = pending.pop()
            pending.extend(node.children.values())
            yield from (row for row, ident in node.rows if ident > node.least)


def failures(text: bytes) -> int:
    """Bits of the filters that one text fails alone: A to D."""
    words = text.split()
    distinct = len(set(words))
    points = len(text.decode())
    plain = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < FEW_WORDS)
        | (100 * distinct < COMMON_SHARE * len(words)) << 1
        | (100 * plain > CAPITAL_SHARE * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


COUNTED = "parent int, step int, prefix binary, weight long, least long, most long"


def _counted(batches: Iterator[pa.RecordBatch], nodes: list[bytes], above: list[int], open_: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Weight of every prefix that goes on from the longest of ``nodes`` that a text starts with, and the range of its texts' hashes."""
    found: dict[tuple[int, int, bytes], list[int]] = {}
    held = 0

    def out() -> pa.RecordBatch:
        values = [(*k, *v) for k, v in found.items()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], [c.split(" ")[0] for c in COUNTED.split(", ")])

    for batch in batches:
        for start, size, mark in zip(utf8(batch.column("start")), batch.column("size").to_pylist(), batch.column("mark").to_pylist()):
            weight = size + ROW_WEIGHT
            if len(start) == size:
                start += LAST
            i = bisect_right(nodes, start) - 1
            while i >= 0 and not start.startswith(nodes[i]):
                i = above[i]
            if i not in open_:
                continue
            for step in STEPS:
                key = (i, step, start[: len(nodes[i]) + step])
                entry = found.get(key)
                if entry is None:
                    found[key] = [weight, mark, mark]
                    held += len(key[2])
                else:
                    entry[0] += weight
                    entry[1], entry[2] = min(entry[1], mark), max(entry[2], mark)
        if held >= RANGE_BYTES:
            yield out()
            found.clear()
            held = 0
    yield out()


def _end(prefix: bytes) -> bytes | None:
    """The first string behind all that start with ``prefix``; none for the last ones."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def _inside(prefixes: list[bytes]) -> list[int]:
    """For sorted prefixes the place of the longest other one that each starts with, or -1."""
    above, path = [], []
    for i, p in enumerate(prefixes):
        while path and not p.startswith(prefixes[path[-1]]):
            path.pop()
        above.append(path[-1] if path else -1)
        path.append(i)
    return above


def text_ranges(docs: DataFrame, least_ranges: int = 1) -> list[tuple[bytes, int]]:
    """Cuts of the order of texts (each with ``LAST`` behind it): (first text, tasks) of every range, in order.

    A range weighs about ``RANGE_BYTES``, less if there would be fewer than
    ``least_ranges``; the list has at most a few entries for each range.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.agg(F.sum(size + ROW_WEIGHT)).first()[0] or 0
    target = max(1, min(RANGE_BYTES, total // max(1, least_ranges)))
    # First texts of pieces with their weights; prefixes of a single text with theirs.
    pieces: dict[bytes, int] = {b"": 0}
    alone: dict[bytes, int] = {}
    nodes, open_ = [b""], {b""}
    while open_:
        reach = max(map(len, nodes)) + STEPS[-1]
        starts = docs.select(F.coalesce(F.substring("text", 1, reach), F.lit("")).alias("start"), size.cast("long").alias("size"), F.xxhash64("text").alias("mark"))
        above, counting = _inside(nodes), frozenset(i for i, p in enumerate(nodes) if p in open_)
        counted = starts.mapInArrow(lambda b, n=nodes, a=above, o=counting: _counted(b, n, a, o), COUNTED)
        per = counted.groupBy("parent", "step", "prefix").agg(F.sum("weight").alias("weight"), (F.min("least") != F.max("most")).alias("varied"))
        # Light prefixes of one parent (some 65,000 at most) are joined to runs before anything reaches the driver.
        light = F.col("weight") <= target
        running = F.sum(F.when(light, F.col("weight")).otherwise(0)).over(Window.partitionBy("parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        runs = per.filter(F.col("step") == STEPS[0]).withColumn("run", F.floor(running / F.lit(target))).filter(light).groupBy("parent", "run").agg(F.min("prefix").alias("prefix"), F.sum("weight").alias("weight"))
        for r in runs.collect():
            pieces[bytes(r["prefix"])] = pieces.get(bytes(r["prefix"]), 0) + r["weight"]
        heavy = {(bytes(r["prefix"])): (r["weight"], r["varied"]) for r in per.filter(~light).orderBy(F.desc("weight")).collect()}
        found = sorted(heavy)
        nested = _inside(found)
        # Of nested prefixes of a single text the shortest stands for all.
        single = {p for p, up in zip(found, nested) if not heavy[p][1] and (up < 0 or heavy[found[up]][1])}
        rest = {p: w for p, (w, varied) in heavy.items() if varied}
        for p, up in zip(found, nested):
            if up >= 0 and found[up] in rest:
                rest[found[up]] -= heavy[p][0]
        alone |= {p: heavy[p][0] for p in single}
        open_ = {p for p, w in rest.items() if w > target}
        pieces |= {p: max(0, w) for p, w in rest.items() if p not in open_}
        nodes = sorted({*nodes, *rest, *single})
    for p in nodes[1:]:
        for edge in (p, _end(p)):
            if edge is not None:
                pieces.setdefault(edge, 0)
    ranges: list[list] = []
    for prefix in sorted(pieces):
        if prefix in alone:
            ranges.append([prefix, 0, -(-alone[prefix] // target)])
        elif ranges and ranges[-1][2] == 1 and ranges[-1][1] + pieces[prefix] <= target:
            ranges[-1][1] += pieces[prefix]
        else:
            ranges.append([prefix, pieces[prefix], 1])
    return [(p, n) for p, _, n in ranges]


ROWS = "doc_id long, part string, mask int, task int, text binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split(" ")[0] for c in ROWS.split(", ")])


DUPLICATE = 1 << FILTERS.index("E")


def _masked(batches: Iterator[pa.RecordBatch], cuts: list[bytes], tasks: list[int], starts: list[int]) -> Iterator[pa.RecordBatch]:
    """Failures of every row; of each different text that the task has seen only rows of the smallest id carry the text on."""
    end = starts[-1] + tasks[-1]
    trie, rows, waiting = Trie(), [], []

    def out() -> pa.RecordBatch:
        known = set(trie.larger())
        for row, (ident, part, mask, text) in enumerate(waiting):
            if row in known:
                rows.append((ident, part, mask | DUPLICATE, ident % end, None))
            else:
                at = bisect_right(cuts, text + LAST) - 1
                rows.append((ident, part, mask, starts[at] + ident % tasks[at], text))
        return _batch(rows)

    for batch in blocks(batches, "text"):
        for ident, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), utf8(batch.column("text"))):
            mask = failures(text)
            if ident is None:
                rows.append((None, part, mask, len(rows) % end, None))
            else:
                trie.insert(text, ident, len(waiting))
                waiting.append((ident, part, mask, text))
        if trie.size >= RANGE_BYTES:
            yield out()
            trie, rows, waiting = Trie(), [], []
    yield out()


def _flagged(batches: Iterator[pa.RecordBatch], shared: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """One range's trie; rows of tasks in ``shared`` keep their text if they may still be duplicates of another task's."""
    trie, waiting = Trie(), []
    for batch in batches:
        done = []
        for ident, part, mask, task, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                done.append((ident, part, mask, task, None))
            else:
                trie.insert(text, ident, len(waiting))
                waiting.append((ident, part, mask, task, text if task in shared else None))
        if done:
            yield _batch(done)
    larger = set(trie.larger())
    for start in range(0, len(waiting), 4096):
        some = waiting[start : start + 4096]
        yield _batch([(i, p, m | DUPLICATE, t, None) if start + k in larger else (i, p, m, t, x) for k, (i, p, m, t, x) in enumerate(some)])


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs(doc_id, source, text)``; bit i of the mask is the failure of filter i."""
    spark = docs.sparkSession
    ranges = text_ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions"))) or [(b"", 1)]
    cuts, tasks = [p for p, _ in ranges], [n for _, n in ranges]
    starts = [int(s) for s in np.cumsum([0, *tasks[:-1]])]
    shared = frozenset(t for s, n in zip(starts, tasks) if n > 1 for t in range(s, s + n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    masked = rows.mapInArrow(lambda b: _masked(b, cuts, tasks, starts), ROWS)
    dealt = masked.repartitionById(starts[-1] + tasks[-1], "task")
    flagged = stored(dealt.mapInArrow(lambda b: _flagged(b, shared), ROWS), "text-tries")
    # Texts of ranges with several tasks: the smallest ids meet, one row a task.
    open_rows = flagged.where(F.col("text").isNotNull())
    met = open_rows.repartition(F.xxhash64("text")).mapInArrow(lambda b: _flagged(b, frozenset()), ROWS)
    return flagged.where(F.col("text").isNull()).select("doc_id", "part", "mask").unionByName(met.select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows by failures and labels."""
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without id, and repeated ones, are one row before they meet the labels.
    few = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    no = F.lit(False)
    return few.join(of, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``mask_counts``.

    A step depends only on its filter and on which filters ran before, so sums are
    made for those 80 cases and then read by the 600 steps.
    """
    n = len(FILTERS)
    steps = [(sum(1 << i for i in order[:k]), 1 << order[k], "".join(FILTERS[i] for i in order), k + 1) for order in permutations(range(n)) for k in range(n)]
    cases = sorted({s[:2] for s in steps})
    each = counts.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in cases])).alias("case")).select("*", "case.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("filter")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    sums = each.groupBy("part", "before", "filter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("filter")).alias("unique_fails"),
        total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    orders = counts.sparkSession.createDataFrame(steps, "before int, filter int, filter_order string, step int")
    # 600 rows whatever the input.
    placed = sums.join(F.broadcast(orders), ["before", "filter"])
    shapley = placed.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return placed.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(mask_counts(failure_masks(docs), table(spark, sf_dir, "labels")))


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
OP11_SQL = rf"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
tested as (
  select doc_id, part, len({_WORDS}) as words, len(list_distinct({_WORDS})) as distinct_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as capitals, length(text) as points,
         regexp_matches(text, '[#$%&*|]') as symbol, coalesce(doc_id > min(doc_id) over (partition by text), false) as repeated
  from docs),
masks as (
  select doc_id, part, (words < 200)::int + 2 * (100 * distinct_words < 50 * words)::int + 4 * (100 * capitals > 2 * points)::int + 8 * symbol::int + 16 * repeated::int as mask
  from tested),
marked as (
  select part, mask, coalesce(quality, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n
  from masks left join (select doc_id, max((quality = 1)::int) as quality, max((toxic = 1)::int) as toxic from labels group by doc_id) using (doc_id)
  group by all),
filters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from filters a, filters b, filters c, filters d, filters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, s as step, bits[s] as filter, list_sum(bits[1:s - 1])::int as before from orders, range(1, 6) r(s)),
audited as (
  select part, filter_order, step, filter, before,
         sum(n) filter (where mask & (coalesce(before, 0) | filter) = 0) as kept,
         sum(n) filter (where mask & coalesce(before, 0) = 0 and mask & filter <> 0) as removed,
         sum(n) filter (where mask & coalesce(before, 0) <> 0 and mask & filter <> 0) as redundant,
         sum(n) filter (where mask = filter) as unique_fails,
         sum(n) filter (where mask & coalesce(before, 0) = 0 and mask & filter <> 0 and good = 1) as good_lost,
         sum(n) filter (where mask & coalesce(before, 0) = 0 and mask & filter <> 0 and toxic = 1) as toxic_lost
  from marked, steps group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, filter), 0)::bigint as shapley
from audited
"""
