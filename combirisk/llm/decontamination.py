"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Index.  Items are cut into chunks of at most CHUNK words; a chunk's BM25 weights are
divided by their sum, so 1 means that every word of it is there.  Chunks get numbers
in order; a posting list has (chunk, weight) by number, its maximum, and the maximum
in each block of BLOCK numbers, on block borders that all lists share.

Queries.  Every window of WINDOW words of a text, STEP words apart, is a query for all
chunks that reach ``threshold``.  The bounds of WAND are taken for many windows at
once: the list maxima of a window's words must reach the threshold, then their block
maxima in some block.  Windows that pass run block-max WAND itself: the pivot is the
first word up to which list maxima reach the threshold, the block maxima at the pivot
decide whether to score or to jump behind the nearest block end.  Nothing above the
threshold is missed.

Verification.  A retrieved item is compared with the text around the window: the share
of its question's and of its answer's word shingles found there.  The last sentence is
the answer; a single sentence is cut at three quarters.

The index is broadcast in shards of about ``shard_chars`` characters of items; every
shard sees every text once, so a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, table, text_key

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s")
CHUNK = 64
WINDOW = 128
STEP = 64
BLOCK = 4
K1, B = 1.2, 0.75
SHINGLE = 5
# Words of texts whose windows are bounded together.
BATCH_WORDS = 1 << 17


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(tokens: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    width = min(width, len(tokens))
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if width else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and in the last sentence; one sentence is cut at three quarters of its words."""
    ends = [m.end() for m in SENTENCE_END.finditer(text.rstrip())]
    for end in reversed(ends):
        question, answer = words(text[:end]), words(text[end:])
        if question and answer:
            return question, answer
    tokens = words(text)
    cut = max(1, len(tokens) * 3 // 4)
    return tokens[:cut], tokens[cut:]


@dataclass
class Posting:
    chunks: np.ndarray
    weights: np.ndarray
    most: float
    blocks: dict[int, float]


@dataclass
class BlockMaxIndex:
    """Inverted index of one shard of items; build with ``add`` and ``close``."""

    items: list[tuple[int, list[str], list[str]]] = field(default_factory=list)
    chunk_item: list[int] = field(default_factory=list)
    chunk_words: list[list[str]] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[Posting] = field(default_factory=list)

    def add(self, item_id: int, text: str) -> None:
        question, answer = question_and_answer(text)
        tokens = question + answer
        if not tokens:
            return
        self.items.append((item_id, question, answer))
        pieces = -(-len(tokens) // CHUNK)
        for i in range(pieces):
            self.chunk_item.append(len(self.items) - 1)
            self.chunk_words.append(tokens[i * len(tokens) // pieces : (i + 1) * len(tokens) // pieces])

    def close(self) -> BlockMaxIndex:
        n = len(self.chunk_words)
        frequency = Counter(w for c in self.chunk_words for w in set(c))
        mean = sum(map(len, self.chunk_words)) / max(n, 1)
        lists: dict[str, list[tuple[int, float]]] = {}
        for number, chunk in enumerate(self.chunk_words):
            weights = {w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(chunk) / mean)) for w, tf in Counter(chunk).items()}
            whole = sum(weights.values())
            for w, x in weights.items():
                lists.setdefault(w, []).append((number, x / whole))
        for w, entries in lists.items():
            self.terms[w] = len(self.postings)
            by_block: dict[int, float] = {}
            for number, x in entries:
                by_block[number // BLOCK] = max(by_block.get(number // BLOCK, 0.0), x)
            self.postings.append(Posting(np.array([e[0] for e in entries]), np.array([e[1] for e in entries]), max(e[1] for e in entries), by_block))
        return self

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """List maxima, and block maxima as a table of words by blocks."""
        most = np.array([p.most for p in self.postings], np.float32)
        table = np.zeros((len(self.postings), len(self.chunk_words) // BLOCK + 1), np.float32)
        for i, p in enumerate(self.postings):
            table[i, list(p.blocks)] = list(p.blocks.values())
        return most, table

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (chunk, score) with score >= threshold for a set of words, by block-max WAND."""
        threshold -= 1e-9
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        now = [int(p.chunks[0]) for p in lists]
        end = len(self.chunk_words)
        alive = list(range(len(lists)))
        out = []

        def advance(i: int, chunk: int) -> None:
            at[i] = int(np.searchsorted(lists[i].chunks, chunk))
            now[i] = int(lists[i].chunks[at[i]]) if at[i] < len(lists[i].chunks) else end

        while True:
            alive = sorted((i for i in alive if now[i] < end), key=now.__getitem__)
            total, pivot = 0.0, -1
            for k, i in enumerate(alive):
                total += lists[i].most
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            chunk = now[alive[pivot]]
            while pivot + 1 < len(alive) and now[alive[pivot + 1]] == chunk:
                pivot += 1
            front = alive[: pivot + 1]
            block = chunk // BLOCK
            if sum(lists[i].blocks.get(block, 0.0) for i in front) >= threshold:
                for i in front:
                    if now[i] < chunk:
                        advance(i, chunk)
                score = sum(float(lists[i].weights[at[i]]) for i in front if now[i] == chunk)
                if score >= threshold:
                    out.append((chunk, score))
                target = chunk + 1
            else:
                # No chunk of this block can reach it with these lists; the next list may join later.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(alive):
                    target = min(target, now[alive[pivot + 1]])
            for i in front:
                if now[i] < target:
                    advance(i, target)


def _windows(n: int) -> list[tuple[int, int]]:
    return [(s, min(s + WINDOW, n)) for s in range(0, max(n - WINDOW + STEP, 1), STEP)]


def candidates(index: BlockMaxIndex, bounds: tuple[np.ndarray, np.ndarray], texts: list[list[str]], threshold: float) -> list[list[tuple[int, int, int, float]]]:
    """For each text, (item number, first word, end word, score) of every window and chunk that reach the threshold."""
    most, by_block = bounds
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    known = index.terms.get
    owners, spans, numbers, lengths = [], [], [], []
    for t, tokens in enumerate(texts):
        ids = np.array([known(w, -1) for w in tokens], np.int64)
        for a, b in _windows(len(tokens)):
            inside = ids[a:b]
            owners.append(t)
            spans.append((a, b))
            numbers.append(inside[inside >= 0])
            lengths.append(len(numbers[-1]))
    if not sum(lengths):
        return found
    window = np.repeat(np.arange(len(lengths)), lengths)
    pairs = np.unique(window * len(most) + np.concatenate(numbers))
    window, term = pairs // len(most), pairs % len(most)
    margin = threshold - 1e-5
    keep = np.bincount(window, most[term], len(lengths)) >= margin
    window, term = window[keep[window]], term[keep[window]]
    starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.zeros(0, np.int64)
    stops = np.append(starts[1:], len(window))
    # Block maxima for a bounded number of (window, word) rows at a time.
    rows = max(1, (1 << 22) // max(by_block.shape[1], 1))
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(stops, starts[k] + rows, side="right")))
        first_row, end_row = starts[k], stops[last - 1]
        best = np.add.reduceat(by_block[term[first_row:end_row]], starts[k:last] - first_row, axis=0).max(axis=1)
        for i in np.flatnonzero(best >= margin) + k:
            w = int(window[starts[i]])
            for chunk, score in index.search(term[starts[i] : stops[i]].tolist(), threshold):
                found[owners[w]].append((index.chunk_item[chunk], *spans[w], score))
        k = last
    return found


def overlaps(index: BlockMaxIndex, tokens: list[str], hits: list[tuple[int, int, int, float]]) -> list[tuple[int, float, float, float]]:
    """(item_id, score, question overlap, answer overlap) for each item hit, compared with the windows' surroundings."""
    by_item: dict[int, list[tuple[int, int, float]]] = {}
    for item, a, b, score in hits:
        by_item.setdefault(item, []).append((a, b, score))
    out = []
    for item, spans in by_item.items():
        item_id, question, answer = index.items[item]
        # All of the item fits beside a window that holds one of its chunks.
        reach = len(question) + len(answer)
        near = set()
        for width in {min(SHINGLE, len(question)), min(SHINGLE, len(answer))}:
            for a, b, _ in spans:
                near |= shingles(tokens[max(0, a - reach) : b + reach], width)
        share = lambda part: len(shingles(part) & near) / len(shingles(part)) if part else 1.0
        out.append((item_id, max(s for _, _, s in spans), share(question), share(answer)))
    return out


def _matches(index: BlockMaxIndex, batches: Iterator[pa.RecordBatch], threshold: float, overlap: float) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, float, float, float]]]]]:
    """Slices of the batches with the verified items of every row."""
    bounds = index.bounds()
    for batch in blocks(batches, "text", 8 * BATCH_WORDS):
        texts = [words(t) for t in batch.column("text").to_pylist()]
        found = candidates(index, bounds, texts, threshold)
        yield batch, [[m for m in overlaps(index, tokens, hits) if m[2] >= overlap and m[3] >= overlap] if hits else [] for hits, tokens in zip(found, texts)]


def _shards(benchmark: DataFrame, shard_chars: int) -> Iterator[BlockMaxIndex]:
    """Indexes over the items, each of about ``shard_chars`` characters (one longer item stands alone)."""
    index, size = BlockMaxIndex(), 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        if size and size + len(text) > shard_chars:
            yield index.close()
            index, size = BlockMaxIndex(), 0
        index.add(item_id, text)
        size += len(text)
    yield index.close()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.5, shard_chars: int = 500_000) -> DataFrame:
    """(doc_id, key, item_id, score, question_overlap, answer_overlap): every text and test item that it contains.

    Both overlaps must reach ``overlap``.  Null and empty texts and items match
    nothing, equal items are found each, null ids stay null.  Rows equal in id and
    text give one row an item.  Further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    context = docs.sparkSession.sparkContext
    schema = "doc_id long, key long, item_id long, score double, question_overlap double, answer_overlap double"

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _matches(shared.value, batches, threshold, overlap):
                ids = zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist())
                got = [(*i, *m) for i, row in zip(ids, found) for m in row]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["doc_id", "key", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, schema)

    parts = [search(context.broadcast(index)) for index in _shards(benchmark, shard_chars)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.5, shard_chars: int = 500_000) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no test item; no shuffle."""
    context = docs.sparkSession.sparkContext

    def clean(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _matches(shared.value, batches, threshold, overlap):
                yield batch.filter(pa.array([not m for m in found], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for index in _shards(benchmark, shard_chars):
        docs = clean(docs, context.broadcast(index))
    return docs


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 9).alias("score"), "question_overlap", "answer_overlap")
