"""Toxic passages as maximal scoring segments of token log-odds.

Model.  A token's evidence is the log-odds of its longest known form: the word
itself, else its prefix of 8, 7, ... 3 letters.  The toxic share of a form has a
Dirichlet prior with the posterior mean of the next shorter form as its mean, and a
mass of ``prior_floor`` plus ``prior_rate`` times the count that the form's rate in
all documents lets expect in the labelled sample.  Rare forms so lean on their
prefix, and frequent ones need evidence in proportion.

Segments.  Log-odds less a drift per token go through the linear-time scan for all
maximal scoring segments of a text.  Best segments of clean texts follow an
extreme-value law, P(S < x) = exp(-K n exp(-lambda x)); lambda and K are fitted by
maximum likelihood.  A segment is significant when fewer than ``significance`` such
are expected in a text of its length; the reduced scores lambda S - ln(K n) of the
significant ones add up, and a logistic curve over the sum gives the score.

The labelled sample has at most ``sample_rows`` rows (those with the smallest hash)
and the model at most ``max_features`` forms; the law and the curve are fitted on
each half of the sample with the counts of the other.  Background counts come from
every document.  Labels enter nowhere else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, table

TOKEN = re.compile(r"\w+")
PREFIXES = (8, 7, 6, 5, 4, 3)
CACHE_WORDS = 1 << 18
THRESHOLD = 0.7
SEGMENTS = "array<struct<first_token:int,last_token:int,score:double>>"
_SEGMENT_TYPE = pa.list_(pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64())]))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def forms(word: str) -> list[str]:
    """The word and its marked prefixes, longest first."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), left to right, in linear time.

    Each positive run enters a stack with the sums before and after it; it merges
    with the nearest earlier segment that starts lower, if its end is higher than
    that segment's end.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float, int]] = []
    for i, left, right in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist()):
        first, j = i, len(stack) - 1
        while True:
            # Segments that start at or above this one can never take it in, nor what follows: skip them for good.
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, i, left, right, j))
                break
            first, _, left, _, below = stack[j]
            del stack[j:]
            j = below
    return [(first, last, right - left) for first, last, left, right, _ in stack]


@dataclass(frozen=True)
class ToxicModel:
    """Log-odds of forms and the fitted laws."""

    odds: dict[str, float]
    drift: float
    significance: float
    rate: float = 1.0
    scale: float = 1.0
    intercept: float = -4.0
    slope: float = 1.0

    def scorer(self) -> Callable[[str | None], tuple[float, list[tuple[int, int, float]]]]:
        """Function text -> (score, significant segments); keeps a bounded word cache."""
        odds, drift, cache = self.odds, self.drift, {}

        def evidence(word: str) -> float:
            value = next((odds[f] for f in forms(word) if f in odds), 0.0) - drift
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            cache[word] = value
            return value

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            words = tokens(text)
            known = cache.get
            values = np.array([v if (v := known(w)) is not None else evidence(w) for w in words], np.float64)
            total, found = self.reduced(maximal_segments(values), len(words))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * total)))), found

        return score

    def reduced(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        floor = math.log(self.scale * max(n, 1))
        limit = -math.log(self.significance)
        found = [s for s in segments if self.rate * s[2] - floor > limit]
        return math.log1p(sum(math.log1p(math.exp(min(self.rate * s[2] - floor, 500.0))) for s in found)), found


def extreme_value_law(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (lambda, K) for best scores in texts of these lengths."""
    if len(best) < 8 or float(np.ptp(best)) == 0:
        return 1.0, 0.1

    def slope(rate: float) -> float:
        weights = lengths * np.exp(-rate * (best - best.min()))
        return 1 / rate - best.mean() + (best * weights).sum() / weights.sum()

    low, high = 0.05, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, len(best) / float((lengths * np.exp(-low * best)).sum())


def logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak pull towards zero."""
    theta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), max(float(theta[1]), 1e-3)


def log_odds(counts: dict[str, tuple[int, int]], background: dict[str, int], sample: int, corpus: int, prior_floor: float, prior_rate: float) -> dict[str, float]:
    """Log-odds of every form against the share of toxic tokens; ``counts`` has (toxic, clean) tokens."""
    toxic = counts.get("", (0, 0))[0]
    root = (toxic + 0.5) / (sample + 1.0)
    share = {"": root}
    out = {}
    for form in sorted((f for f in counts if f), key=lambda f: (not f.endswith("*"), len(f))):
        parent = next((p for p in forms(form.rstrip("*"))[1:] if p != form and p in share), "")
        t, c = counts[form]
        mass = prior_floor + prior_rate * sample * background.get(form, 0) / max(corpus, 1)
        share[form] = (t + mass * share[parent]) / (t + c + mass)
        out[form] = math.log(share[form] / (1 - share[form])) - math.log(root / (1 - root))
    return out


def _count_forms(texts: Iterable[str | None], keep: dict[str, int] | None = None) -> Counter:
    words: Counter = Counter()
    for text in texts:
        words.update(tokens(text))
    out: Counter = Counter()
    for word, n in words.items():
        for form in forms(word):
            if keep is None or form in keep:
                out[form] += n
    out[""] = sum(words.values())
    return out


def held_out(doc_id: Column) -> Column:
    """Fold that no label is learned from; null ids have the checksum of no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic, half): at most ``rows`` labelled documents outside the held-out fold."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("sample"))
    chosen = chosen.orderBy(draw, "doc_id").limit(rows).select("doc_id", "toxic", draw.bitwiseAND(F.lit(1)).alias("half"))
    # At most ``rows`` rows of three numbers are broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, max_features: int = 120_000, min_count: int = 2, drift: float = 0.7, significance: float = 1.0, prior_floor: float = 1.0, prior_rate: float = 0.05) -> ToxicModel:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.  Without labels of both kinds every score is low."""
    context = docs.sparkSession.sparkContext
    sample = labelled_sample(docs, labels, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (toxic, half), part in frame.groupby(["toxic", "half"]):
                found = _count_forms(part["text"])
                n = len(found)
                cell = 2 * int(half) + (toxic > 0)
                yield pa.RecordBatch.from_pydict({"form": list(found), **{f"n{i}": list(found.values()) if i == cell else [0] * n for i in range(4)}})

    cells = [f"n{i}" for i in range(4)]
    counted = sample.select("text", "toxic", "half").mapInArrow(count, "form string, " + ", ".join(f"{c} long" for c in cells))
    counted = counted.groupBy("form").agg(*[F.sum(c).alias(c) for c in cells]).withColumn("n", sum(F.col(c) for c in cells)).where(F.col("n") >= min_count)
    kept = counted.orderBy(F.desc("n"), "form").limit(max_features + 1).toPandas()
    if kept.empty or not kept[["n0", "n2"]].to_numpy().sum() or not kept[["n1", "n3"]].to_numpy().sum():
        return ToxicModel({}, drift, significance)
    place = {form: i for i, form in enumerate(kept["form"])}
    places = context.broadcast(place)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = places.value
        total = np.zeros(len(keep), np.int64)
        for batch in batches:
            for block in blocks([batch], "text"):
                found = _count_forms(block.column("text").to_pylist(), keep)
                total[[keep[f] for f in found]] += np.fromiter(found.values(), np.int64, len(found))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": seen, "n": total[seen]})

    rates = docs.select("text").mapInArrow(background, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    everywhere = dict(zip(kept["form"].iloc[rates["place"]], rates["n"].tolist()))
    places.unpersist()

    def model(columns: tuple[tuple[str, ...], tuple[str, ...]]) -> dict[str, float]:
        clean, toxic = (kept[list(c)].sum(axis=1).tolist() for c in columns)
        counts = {f: (t, c) for f, t, c in zip(kept["form"], toxic, clean) if t or c}
        return log_odds(counts, everywhere, sum(counts.get("", (0, 0))), everywhere.get("", 0), prior_floor, prior_rate)

    halves = context.broadcast([ToxicModel(model((("n2",), ("n3",))), drift, significance), ToxicModel(model((("n0",), ("n1",))), drift, significance)])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Half 0 is scored by the counts of half 1 and the other way round.
        odds = [m.odds for m in halves.value]
        for batch in batches:
            rows = []
            for text, toxic, half in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("half").to_pylist()):
                words = tokens(text)
                values = np.array([next((odds[half][f] for f in forms(w) if f in odds[half]), 0.0) - drift for w in words])
                segments = sorted((s[2] for s in maximal_segments(values)), reverse=True)
                rows.append((int(toxic > 0), len(words), segments))
            yield pa.RecordBatch.from_pydict({"toxic": [r[0] for r in rows], "n": [r[1] for r in rows], "segments": [r[2] for r in rows]}, schema=pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))]))

    trial = sample.select("text", "toxic", "half").mapInArrow(crossed, "toxic long, n long, segments array<double>").toPandas()
    halves.unpersist()
    return _calibrated(ToxicModel(model((("n0", "n2"), ("n1", "n3"))), drift, significance), trial)


def _calibrated(model: ToxicModel, trial: pd.DataFrame) -> ToxicModel:
    best = trial["segments"].map(lambda s: s[0] if len(s) else 0.0).to_numpy(np.float64)
    n = trial["n"].clip(lower=1).to_numpy(np.float64)
    toxic = trial["toxic"].to_numpy()
    clean = (toxic == 0) & (best > 0)
    rate, scale = extreme_value_law(best[clean], n[clean])
    model = ToxicModel(model.odds, model.drift, model.significance, rate, scale)
    sums = np.array([model.reduced([(0, 0, s) for s in row], int(m))[0] for row, m in zip(trial["segments"], trial["n"])])
    intercept, slope = logistic_curve(sums, toxic.astype(np.float64))
    return ToxicModel(model.odds, model.drift, model.significance, rate, scale, intercept, slope)


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, segments) for every row of ``docs(doc_id, text)``.

    ``segments`` lists the significant passages by token numbers.  Null and empty
    texts have no segment and the score of none; repeated rows and null ids come
    out as they come in; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in blocks(batches, "text"):
            rows = [score(t) for t in batch.column("text").to_pylist()]
            segments = pa.array([[{"first_token": a, "last_token": b, "score": s} for a, b, s in r[1]] for r in rows], _SEGMENT_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()), segments], ["doc_id", "score", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, score double, segments {SEGMENTS}")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t)[0] < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")
