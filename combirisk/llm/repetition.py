"""Quality rules with suffix-array repetition.

For every text: plain counts, then a suffix array over its words.  Suffixes that
share their first three words with another one are refined until sorted; Kasai's
scan gives their common prefixes.  The innermost common-prefix interval around a
suffix is the longest repeated substring that starts there; the union of these
spans is what maximal repeats cover.  A text is kept when repeats of at least
``min_repeat`` words cover no more than ``max_covered`` of it and the longest is no
more than ``max_longest`` of it.

Texts are taken in blocks of bounded bytes; a longer one makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, table, utf8
from combirisk.llm.suffixes import covered, deepest, first_groups, kasai, refine, shared_only

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat")


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def word_repeats(texts: list[list[bytes]], min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words: words in repeated windows of three, words that long repeats cover, longest repeat."""
    counts = np.array([len(words) for words in texts], np.int64)
    # One stop symbol after every text; words of different texts get different numbers.
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    symbols: list[int] = []
    known = 0
    for words in texts:
        numbers: dict[bytes, int] = {}
        symbols.extend([numbers.setdefault(w, known + len(numbers)) for w in words])
        known += len(numbers)
        symbols.append(known)
        known += 1
    ids = np.array(symbols, np.int64)
    n = len(ids)
    none = np.zeros(len(texts), np.int64)
    if n < WINDOW + 1:
        return none, none.copy(), none.copy()
    padded = np.append(ids, [0, 0])
    if known < 1 << 21:
        keys = (padded[:-2] * known + padded[1:-1]) * known + padded[2:]
    else:
        pair = np.unique(padded[:-1] * known + padded[1:], return_inverse=True)[1]
        keys = pair[:-1] * known + padded[2:]
    # A window over a stop symbol is the only one of its kind.
    order, starts = first_groups(keys)
    shared = shared_only(starts)
    if not shared.any():
        return none, none.copy(), none.copy()
    heads = (starts == np.arange(n))[shared]
    refine(order, starts, WINDOW)
    suffixes = order[shared]
    common = deepest(kasai(symbols, suffixes, heads, WINDOW))
    owner = np.searchsorted(begins, suffixes, side="right") - 1
    longest = none.copy()
    np.maximum.at(longest, owner, common)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[begins[1:]] - total[begins[:-1]]

    windows = covered(suffixes, suffixes + WINDOW, n)
    far = common >= min_repeat
    spans = covered(suffixes[far], suffixes[far] + common[far], n)
    return per_text(windows), per_text(spans), longest


def text_measures(texts: list[bytes], n_chars: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    white = np.array([len(t) - len(t.translate(None, WHITE)) for t in texts], np.int64)
    repeat_words, spans, longest = word_repeats(words, min_repeat)
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": n_chars - white,
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat_words,
        "repeat_covered": spans,
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.3, max_longest: float = 0.2) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of ``docs(doc_id, text)``.

    Null and empty texts have all counts 0, fail the base rules and are not kept.
    Repeated rows and null ids come out as they come in; further columns are
    ignored; an empty table gives no row.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            n_chars = pc.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            measures = text_measures(utf8(batch.column("text")), n_chars, min_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(measures[c]) for c in COLUMNS]], ["doc_id", *COLUMNS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repetitive = (F.col("repeat_covered") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~repetitive)


def op6_repetition_rules(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
