"""Masked pseudo-likelihood with a bidirectional window network, trained in numpy.

Every token is predicted from the two words before and the two after it.  Each of the
four places has its own embeddings; their sum goes through tanh, and a softmax over
groups of the vocabulary, then one inside the group, gives the probability.  The score
of a text is the sum of the log-probabilities of all of its tokens.

Vocabulary: every word of all documents.  The most frequent have a symbol of the
network; the others share hash buckets, and a word's probability is its bucket's times
its share n / (N + 1) of the N tokens counted there, where the 1 is all unseen words.
The shares of words counted twice and more are joined to the texts' words, so the table
may grow with the input.  Symbol and bucket counts set the biases, so training starts
from the unigram model.

Training: every token of every document is masked and predicted once.  The tokens are
dealt into ``parts`` by a hash of doc_id and position; round r predicts part r, with all
others as context.  Each task trains
a copy of the network on its documents; the copies, weighted by their tokens, are
averaged by rounds of group sums over a tree, and the mean starts the next round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, stored, table

WORD = re.compile(r"\w+")
PLACES = (-2, -1, 1, 2)
REACH = 2
GROUPS = 64
MEMBERS = 64
SYMBOLS = GROUPS * MEMBERS
BUCKETS = 512
FIRST_BUCKET = SYMBOLS - BUCKETS
EDGE = 0
WIDTH = 32
BATCH = 2048
# Tokens scored together.
SCORED = 1 << 15
COUNTED_WORDS = 1 << 17
# Models that one task sums up at a level of the tree.
FAN_IN = 32
CACHE_WORDS = 1 << 18
RATE = 0.5


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Network:
    """Parameters by name, all float32."""

    places: np.ndarray
    bias: np.ndarray
    groups: np.ndarray
    group_bias: np.ndarray
    members: np.ndarray
    member_bias: np.ndarray

    NAMES = ("places", "bias", "groups", "group_bias", "members", "member_bias")

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """Small random embeddings and, as biases, the logarithms of the symbol counts."""
        draw = np.random.default_rng(seed)
        counts = (counts + 1.0).reshape(GROUPS, MEMBERS)
        normal = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        whole = counts.sum(axis=1)
        return cls(
            normal(len(PLACES), SYMBOLS, WIDTH),
            np.zeros(WIDTH, np.float32),
            normal(WIDTH, GROUPS),
            np.log(whole / whole.sum()).astype(np.float32),
            normal(GROUPS, WIDTH, MEMBERS),
            np.log(counts / whole[:, None]).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def from_flat(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for a in self.arrays():
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def hidden(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = self.bias + self.places[0][symbols[at + PLACES[0]]]
        for table_, place in zip(self.places[1:], PLACES[1:]):
            total += table_[symbols[at + place]]
        return np.tanh(total)

    def log_probabilities(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Conditional log-probability of the symbols at ``at``; the array has edge symbols around every text."""
        out = np.empty(len(at), np.float64)
        for start in range(0, len(at), SCORED):
            part = at[start : start + SCORED]
            group, member = np.divmod(symbols[part], MEMBERS)
            order = np.argsort(group, kind="stable")
            h = self.hidden(symbols, part[order])
            group, member = group[order], member[order]
            result = _log_chosen(h @ self.groups + self.group_bias, group)
            bounds = np.searchsorted(group, np.arange(GROUPS + 1))
            for g in np.flatnonzero(np.diff(bounds)):
                rows = slice(bounds[g], bounds[g + 1])
                result[rows] += _log_chosen(h[rows] @ self.members[g] + self.member_bias[g], member[rows])
            out[start + order] = result
        return out


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-softmax of one column a row; works in place and writes no other column."""
    logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(logits)), chosen]
    np.exp(logits, out=logits)
    return picked - np.log(logits.sum(axis=1))


class Trainer:
    """Adagrad on a copy of a network; embeddings have one step size a row."""

    def __init__(self, network: Network) -> None:
        self.net = Network(*[a.copy() for a in network.arrays()])
        self.seen = [np.full(a.shape[:2], 1e-2, np.float32) if i == 0 else np.full(a.shape, 1e-2, np.float32) for i, a in enumerate(self.net.arrays())]
        self.tokens = 0

    def _step(self, i: int, gradient: np.ndarray, where=...) -> None:
        self.seen[i][where] += gradient * gradient
        self.net.arrays()[i][where] -= RATE * gradient / np.sqrt(self.seen[i][where])

    def train(self, symbols: np.ndarray, at: np.ndarray) -> None:
        for start in range(0, len(at), BATCH):
            self._batch(symbols, at[start : start + BATCH])

    def _batch(self, symbols: np.ndarray, at: np.ndarray) -> None:
        net, n = self.net, len(at)
        self.tokens += n
        at = at[np.argsort(symbols[at], kind="stable")]
        group, member = np.divmod(symbols[at], MEMBERS)
        h = net.hidden(symbols, at)
        outer = np.exp(_log_softmax(h @ net.groups + net.group_bias))
        outer[np.arange(n), group] -= 1
        back = outer @ net.groups.T
        bounds = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in np.flatnonzero(np.diff(bounds)):
            rows = slice(bounds[g], bounds[g + 1])
            inner = np.exp(_log_softmax(h[rows] @ net.members[g] + net.member_bias[g]))
            inner[np.arange(len(inner)), member[rows]] -= 1
            back[rows] += inner @ net.members[g].T
            self._step(4, h[rows].T @ inner / n, g)
            self._step(5, inner.sum(axis=0) / n, g)
        self._step(2, h.T @ outer / n)
        self._step(3, outer.sum(axis=0) / n)
        back *= (1 - h * h) / n
        self._step(1, back.sum(axis=0))
        for i, place in enumerate(PLACES):
            near = symbols[at + place]
            order = np.argsort(near, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
            which = near[order][firsts]
            sums = np.add.reduceat(back[order], firsts, axis=0)
            self.seen[0][i, which] += (sums * sums).mean(axis=1)
            net.places[i, which] -= RATE * sums / np.sqrt(self.seen[0][i, which])[:, None]


class Coder:
    """Words to symbols: known words by frequency, others by a hash into buckets, with a bounded cache."""

    def __init__(self, known: dict[str, int], floors: np.ndarray) -> None:
        self.known = known
        # Log share of a word that was counted once or never, for every bucket.
        self.floors = floors
        self.cache: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = FIRST_BUCKET + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = found
        return found

    def texts(self, texts: list[str | None], rare: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with edges between, places of their tokens, and each text's number of tokens; ``rare`` gets its words without a symbol of their own."""
        known, symbol = self.cache.get, self.symbol
        out: list[int] = [EDGE] * REACH
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            tokens = words(text)
            counts[i] = len(tokens)
            codes = [s if (s := known(w)) is not None else symbol(w) for w in tokens]
            if rare is not None:
                rare.append(Counter([w for w, s in zip(tokens, codes) if s >= FIRST_BUCKET]))
            out += codes
            out += [EDGE] * REACH
        first = REACH + np.cumsum(counts + REACH) - counts - REACH
        at = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        return np.array(out, np.int64), at, counts


def part_of(ids: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """Part of every token, from its text's id and its position there, so batches and partitions do not matter."""
    position = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        z = np.repeat(ids, counts).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + position.astype(np.uint64)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((z ^ (z >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for block in blocks(batches, "text"):
            for text in block.column("text").to_pylist():
                seen.update(words(text))
            if len(seen) >= COUNTED_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of models by group, with at most FAN_IN models of a few groups in a task."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for group, tokens, values in zip(batch.column("branch").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights").to_pylist()):
            row = np.frombuffer(values, np.float32).astype(np.float64)
            n, total = sums.get(group, (0, 0.0))
            sums[group] = (n + tokens, total + row)
    for group, (tokens, total) in sums.items():
        yield pa.RecordBatch.from_pydict({"branch": [group], "tokens": [tokens], "weights": [total.astype(np.float32).tobytes()]}, schema=pa.schema([("branch", pa.int64()), ("tokens", pa.int64()), ("weights", pa.binary())]))


_MODEL = "branch long, tokens long, weights binary"


def train_round(docs: DataFrame, network: Network, coder: Coder, part: int, parts: int) -> Network:
    """One pass over all documents with the tokens of ``part`` masked; mean of the tasks' networks."""
    shared = docs.sparkSession.sparkContext.broadcast((network, coder))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, coder = shared.value
        trainer = Trainer(network)
        for block in blocks(batches, "text"):
            symbols, at, counts = coder.texts(block.column("text").to_pylist())
            ids = block.column("doc_id").fill_null(-1).to_numpy()
            trainer.train(symbols, at[part_of(ids, counts, parts) == part])
        if trainer.tokens:
            weights = trainer.net.flat() * np.float32(trainer.tokens)
            yield pa.RecordBatch.from_pydict({"branch": [TaskContext.get().partitionId()], "tokens": [trainer.tokens], "weights": [weights.tobytes()]}, schema=pa.schema([("branch", pa.int64()), ("tokens", pa.int64()), ("weights", pa.binary())]))

    models = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(train, _MODEL), "networks")
    while (last := models.agg(F.max("branch")).first()[0] or 0) > 0:
        grouped = models.withColumn("branch", F.floor(F.col("branch") / FAN_IN))
        models = stored(grouped.repartition(last // FAN_IN + 1, "branch").mapInArrow(_summed, _MODEL), "networks")
    found = models.first()
    shared.unpersist()
    return network if found is None else network.from_flat(np.frombuffer(found["weights"], np.float32).astype(np.float64) / found["tokens"])


def fit(docs: DataFrame, rounds: int = 2, parts: int = 2) -> tuple[Network, Coder, DataFrame]:
    """Network, its vocabulary and the (word, log_n) of the other words counted twice and more, from all rows of ``docs(doc_id, text)``; without words the network stays at its start."""
    counts = stored(word_counts(docs), "word-counts")
    known_words = FIRST_BUCKET - 1
    top = counts.orderBy(F.desc("n"), "word").limit(known_words).collect()
    known = {r["word"]: i + 1 for i, r in enumerate(top)}
    symbol_counts = np.zeros(SYMBOLS)
    symbol_counts[1 : len(top) + 1] = [r["n"] for r in top]
    # At most ``known_words`` words are broadcast.
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in known], "word string")), "word", "left_anti")
    for r in rest.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        symbol_counts[FIRST_BUCKET + r["bucket"]] = r["n"]
    coder = Coder(known, -np.log(symbol_counts[FIRST_BUCKET:] + 1))
    network = Network.start(symbol_counts)
    for part in range(rounds):
        network = train_round(docs, network, coder, part, parts)
    return network, coder, rest.where("n > 1").select("word", F.log(F.col("n").cast("double")).alias("log_n"))


def score(docs: DataFrame, model: tuple[Network, Coder, DataFrame]) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) for every row of ``docs(doc_id, text)``.

    Texts without words have sum 0 and a null mean; null ids and repeated rows stay;
    further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, coder = shared.value
        row = TaskContext.get().partitionId() << 33
        for block in blocks(batches, "text"):
            rare: list[Counter] = []
            symbols, at, counts = coder.texts(block.column("text").to_pylist(), rare)
            logs = network.log_probabilities(symbols, at)
            chosen = symbols[at]
            inside = chosen >= FIRST_BUCKET
            logs[inside] += coder.floors[chosen[inside] - FIRST_BUCKET]
            sums = np.bincount(np.repeat(np.arange(len(counts)), counts), logs, len(counts)).astype(np.float64)
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            words_ = pa.array([w for found in rare for w in found], pa.string())
            times = pa.array([n for found in rare for n in found.values()], pa.int32())
            lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (words_, times)]
            ids = pa.array(row + np.arange(len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([ids, block.column("doc_id"), pa.array(counts), pa.array(sums), *lists], ["row", "doc_id", "n_tokens", "sum", "words", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, n_tokens long, sum double, words array<string>, times array<int>")
    rows = stored(rows, "scored-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    more = rare.join(model[2], "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("more"))
    whole = rows.drop("words", "times").join(more, "row", "left").select("doc_id", "n_tokens", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return whole.withColumn("per_token", F.try_divide("log_likelihood", "n_tokens"))


def op9_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
