"""Suffix-array removal of every 200-byte string that also starts anywhere else.

Anchors.  Every window of SPAN bytes has an anchor: the lowest hash of its GRAM-byte
pieces.  Equal windows have equal anchors.  Neighbouring windows with one anchor
make a segment (their bytes, at most 2 * SPAN - GRAM), so a text falls into few
segments, and windows can only be equal inside the segments of one anchor.

Counting.  Segments are counted by anchor and the 128-bit digest of all their bytes.
A segment that occurs twice has only repeated windows.  Where an anchor has several different segments,
or recurs inside one, a copy of each goes to a shard: windows of different segments,
or overlapping ones of periodic text, may be equal, too.

Shards.  A shard holds whole anchors up to a bound of segments; an anchor above it
is dealt over several shards.  In a shard, the suffix array comes from
Larsson-Sadakane refinement and common prefixes from Kasai's scan; window starts
whose neighbour in the array shares SPAN bytes are repeated.  For dealt anchors, the
distinct windows of each shard are then merged: dealt by digest into ranges and
compared with their neighbours in the sorted range.

Nothing quadratic: copies only raise counts, and every segment is in one shard.
Texts are worked off in pieces that overlap by SPAN, so their length is not bounded.
The anchor's hash only brings windows together.  Bytes are removed on equal bytes in
a shard, and elsewhere on equal BLAKE2b digests of 128 bits over every byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, stored, table, text_key, utf8
from combirisk.llm.suffixes import covered, first_groups, kasai, refine, shared_only

SPAN = 200
GRAM = 32
# Window starts that can share one occurrence of an anchor.
STARTS = SPAN - GRAM + 1
# Bytes hashed at once: 8-byte numbers for each, in about eight arrays.
PIECE = 1 << 20
SHARD_SEGMENTS = 4096
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
# Both halves of a segment's digest.
_DIGEST = ["segment", "segment2"]
_SEGMENT = "anchor long, segment long, segment2 long, doc_id long, key long, start int, starts int, recurs boolean"


def _avalanched(a: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One-to-one; every bit of ``a`` reaches every bit."""
    z = a ^ (a >> np.uint64(32))
    z *= factor
    z ^= z >> np.uint64(29)
    z *= _C
    z ^= z >> np.uint64(32)
    return z


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two neighbouring pieces, each mixed apart before they meet."""
    z = _avalanched(a, _A)
    z += _avalanched(b, _B)
    return z


def _digests(data: bytes | memoryview, starts: list[int], stops: list[int]) -> np.ndarray:
    """128-bit digest of each slice, as two numbers a row."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(starts, stops)]), "<i8").reshape(-1, 2)


def _words(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from every offset on, as one number."""
    return np.ndarray((len(data) - 7,), order, data, strides=(1,)).astype(np.uint64)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts that end at ``ends``: anchor, first start, number of starts, text number, whether its anchor may recur inside."""
    n = len(data)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    long = ends - begins >= SPAN
    if not long.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool))
    with np.errstate(over="ignore"):
        h8 = _words(data)
        h16 = _mixed(h8[:-8], h8[8:])
        h32 = _mixed(h16[:-16], h16[16:])
        anchors = _lowest(h32, STARTS)
        m = len(anchors)
        edges = np.zeros(n + 1, np.int32)
        np.add.at(edges, begins[long], 1)
        np.add.at(edges, ends[long] - SPAN + 1, -1)
        whole = np.cumsum(edges[:m]) > 0
        fresh = np.ones(m, bool)
        fresh[1:] = (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1])
        fresh[begins[begins < m]] = True
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], m)
        first, last = first[whole[first]], last[whole[first]]
        # An anchor that repeats itself makes longer runs; they are cut.
        parts = -(-(last - first) // STARTS)
        run = np.repeat(np.arange(len(first)), parts)
        number = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[run] + number * STARTS
        stop = np.minimum(start + STARTS, last[run])

        # Windows that overlap in one segment can be equal only where its anchor recurs.  Between two occurrences
        # that one window could hold lies no other anchor, so they are neighbours among the anchors' places.
        gap = np.zeros(STARTS - 1, np.uint64)
        places = np.flatnonzero(~_lowest(~np.concatenate([gap, anchors, gap]), STARTS) == h32)
        again = np.flatnonzero((h32[places[1:]] == h32[places[:-1]]) & (np.diff(places) < STARTS))
        inside = np.searchsorted(places[again + 1], stop + STARTS - 1) > np.searchsorted(places[again], start)
        return anchors[start], start, stop - start, np.searchsorted(ends, start, side="right"), inside


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Concatenations of about PIECE bytes: data, ends, text numbers and offsets in the text."""
    data, ends, owners, offsets, size = [], [], [], [], 0
    for owner, text in enumerate(texts):
        for offset in range(0, max(len(text) - SPAN + 1, 1), PIECE):
            part = text[offset : offset + PIECE + SPAN - 1]
            data.append(part)
            size += len(part)
            ends.append(size)
            owners.append(owner)
            offsets.append(offset)
            if size >= PIECE:
                yield b"".join(data), np.array(ends), np.array(owners), np.array(offsets)
                data, ends, owners, offsets, size = [], [], [], [], 0
    if size >= SPAN:
        yield b"".join(data), np.array(ends), np.array(owners), np.array(offsets)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        ids, keys = batch.column("doc_id"), batch.column("key")
        for data, ends, owners, offsets in _pieces(utf8(batch.column("text"))):
            anchor, start, starts, part, inside = segments(np.frombuffer(data, np.uint8), ends)
            segment = _digests(memoryview(data), start.tolist(), (start + starts + (SPAN - 1)).tolist())
            begins = np.concatenate([[0], ends[:-1]])
            at = (start - begins[part] + offsets[part]).astype(np.int32)
            owner = pa.array(owners[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(segment[:, 0]), pa.array(segment[:, 1]), pc.take(ids, owner), pc.take(keys, owner), pa.array(at), pa.array(starts.astype(np.int32)), pa.array(inside)],
                ["anchor", *_DIGEST, "doc_id", "key", "start", "starts", "recurs"],
            )


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in blocks(batches, "text"):
        rows: dict[str, list] = {c: [] for c in ("anchor", "segment", "n", "shard", "doc_id", "key", "start", "starts", "bytes")}
        for text, doc_id, key, wanted in zip(utf8(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("wanted").to_pylist()):
            for w in wanted:
                rows["doc_id"].append(doc_id)
                rows["key"].append(key)
                rows["bytes"].append(text[w["start"] : w["start"] + w["starts"] + SPAN - 1])
                for c in ("anchor", "segment", "n", "shard", "start", "starts"):
                    rows[c].append(w[c])
        kinds = {"n": pa.int64(), "start": pa.int32(), "starts": pa.int32(), "shard": pa.int32(), "bytes": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()], list(rows))


def repeated_starts(parts: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the first ``starts`` positions of each part (positions in their concatenation): those whose SPAN bytes start again at another of them, and all."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = b"".join(parts)
    data = np.frombuffer(text + bytes(8), np.uint8)
    owned = covered(begins, begins + starts, len(text))
    order, groups = first_groups(_words(data, ">u8")[: len(text)])
    # Neighbours that tie on 128 bytes are worth counting; the last round orders them by 256.
    groups = refine(order, groups, 8, 128)
    refine(order, groups, 128, SPAN)
    keep = owned[order] & shared_only(groups)
    suffixes, groups = order[keep], groups[keep]
    heads = np.ones(len(groups), bool)
    heads[1:] = groups[1:] != groups[:-1]
    listed = np.zeros(len(text) + 1, bool)
    listed[suffixes] = True
    again = kasai(text, suffixes, heads, 128, SPAN, listed.tobytes()) >= SPAN
    again[:-1] |= again[1:]
    return np.sort(suffixes[again]), np.flatnonzero(owned)


def _runs(positions: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of neighbouring positions inside one part."""
    fresh = np.ones(len(positions), bool)
    fresh[1:] = (np.diff(positions) != 1) | (parts[1:] != parts[:-1])
    first = np.flatnonzero(fresh)
    return first, np.append(first, len(positions))[1:] - 1


def _shard_rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of one shard and, for dealt anchors, its distinct windows."""
    parts = [r["bytes"] for r in rows]
    begins = np.cumsum([0] + [len(p) for p in parts])[:-1]
    again, owned = repeated_starts(parts, np.array([r["starts"] for r in rows], np.int64))
    doc_id = pa.array([r["doc_id"] for r in rows], pa.int64())
    key = pa.array([r["key"] for r in rows], pa.int64())
    offset = np.array([r["start"] for r in rows], np.int64) - begins

    def out(part: np.ndarray, start: np.ndarray, stop: np.ndarray, window: np.ndarray | None) -> pa.RecordBatch:
        index, n = pa.array(part), len(part)
        halves = [pa.nulls(n, pa.int64())] * 2 if window is None else [pa.array(window[:, 0]), pa.array(window[:, 1])]
        return pa.RecordBatch.from_arrays([pc.take(doc_id, index), pc.take(key, index), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), *halves], ["doc_id", "key", "start", "stop", "window", "window2"])

    part = np.searchsorted(begins, again, side="right") - 1
    first, last = _runs(again, part)
    yield out(part[first], again[first] + offset[part[first]], again[last] + offset[part[first]] + SPAN, None)
    dealt = np.array([r["shard"] >= 0 for r in rows])
    part = np.searchsorted(begins, owned, side="right") - 1
    owned, part = owned[dealt[part]], part[dealt[part]]
    if len(owned):
        # One row for each distinct window of an anchor in this shard.
        digests = _digests(memoryview(b"".join(parts)), owned.tolist(), (owned + SPAN).tolist())
        order, same = _sorted_digests(digests[:, 0], digests[:, 1])
        one = order[~same]
        at = owned[one] + offset[part[one]]
        yield out(part[one], at, at + SPAN, digests[one])


def _sorted_digests(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the digests and, for each place in it, whether the one before is equal."""
    order = np.lexsort((low, high))
    same = np.zeros(len(order), bool)
    same[1:] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    return order, same


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the anchors of a partition, which come sorted, into shards."""
    shard: list[dict] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            group = (row["anchor"], row["shard"])
            if len(shard) >= SHARD_SEGMENTS and group != last:
                yield from _shard_rows(shard)
                shard = []
            shard.append(row)
            last = group
    if shard:
        yield from _shard_rows(shard)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of dealt anchors that stand in more than one shard, found among the sorted digests."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got)
    order, same = _sorted_digests(rows.column("window").to_numpy(), rows.column("window2").to_numpy())
    again = same.copy()
    again[:-1] |= same[1:]
    yield from rows.take(pa.array(order[again])).select(["doc_id", "key", "start", "stop"]).combine_chunks().to_batches()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop): byte spans of ``docs(doc_id, key, text)`` whose windows all start elsewhere, too; spans may overlap."""
    found = docs.select("doc_id", "key", "text").mapInArrow(_segment_batches, _SEGMENT)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.max("recurs").alias("any")).where("total > 1 or any").select("anchor")
    common = stored(found.join(often, "anchor"), "common-segments")
    each = common.groupBy("anchor", *_DIGEST).agg(F.count(F.lit(1)).alias("n"))
    kinds = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    known = stored(common.join(each.join(kinds, "anchor"), ["anchor", *_DIGEST]), "counted-segments")
    twice = known.where("n > 1").select("doc_id", "key", "start", (F.col("start") + F.col("starts") + (SPAN - 1)).alias("stop"))

    copies = known.where("kinds > 1 or recurs").groupBy("anchor", *_DIGEST).agg(*[F.first(c).alias(c) for c in ("n", "kinds", "doc_id", "key", "start", "starts")])
    shards = F.ceil(F.col("kinds") / SHARD_SEGMENTS)
    shard = F.when(shards > 1, F.pmod("segment", shards)).otherwise(F.lit(-1)).cast("int")
    wanted = copies.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "segment", "n", shard.alias("shard"), "start", "starts")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "wanted")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "text", "wanted")
    cut = texts.mapInArrow(_cut_batches, "anchor long, segment long, n long, shard int, doc_id long, key long, start int, starts int, bytes binary")
    dealt = cut.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    spans = "doc_id long, key long, start int, stop int"
    local = stored(dealt.mapInArrow(_shard_batches, spans + ", window long, window2 long"), "shard-spans")
    merged = local.where("window is not null").repartition("window").mapInArrow(_merge_batches, spans)
    return twice.union(local.where("window is null").select("doc_id", "key", "start", "stop")).union(merged)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as sorted spans that do not touch."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[e for s in spans for e in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame) -> DataFrame:
    """Add ``_spans`` to every row of ``docs``, which has ``doc_id`` (long), ``key`` and ``text``; null where there is none."""
    # Spans of one text are at most its bytes; repeated rows share them.
    spans = repeated_spans(docs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_spans")
    return docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").drop("_doc", "_key")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], bytes]]:
    for text, spans in zip(utf8(batch.column("text")), batch.column("_spans").to_pylist()):
        merged = merged_spans([(s["start"], s["stop"]) for s in spans or ()])
        yield text, merged, without(text, merged)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs(doc_id, text)``.

    Null is an empty text; texts under 200 bytes keep everything.  Rows that repeat
    a whole text of 200 bytes and more lose it, every copy.  Null ids and repeated
    rows come out as they come in; further columns are ignored.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = [(len(t), len(t) - len(k), len(s), hashlib.sha256(k).hexdigest(), [{"start": a, "stop": b} for a, b in s]) for t, s, k in _kept(batch)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    return _with_spans(rows).select("doc_id", "text", "_spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all rows and columns, each text without its repeated bytes and ``n_chars`` anew.

    Bytes of a character that was cut in the middle go, too.  A null text stays null.
    """
    columns = docs.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text")
            texts = pa.array([k.decode("utf-8", "ignore") if v else None for (_, _, k), v in zip(_kept(batch), old.is_valid().to_pylist())], pa.string())
            anew = {"text": texts, "n_chars": pc.utf8_length(texts)}
            row = batch.column("row").flatten()
            yield pa.RecordBatch.from_arrays([anew[c].cast(v.type) if c in anew else v for c, v in zip(columns, row)], columns)

    # The row travels as one struct, so no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    return _with_spans(rows).select("row", "text", "_spans").mapInArrow(finish, docs.schema)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
