"""Token counts by field: documents are encoded once, tokens are attributed by their spans.

A record is its fields and sections in one text.  The encoder runs over the whole
record, because a token may begin in one field and end in the next; counting fields
apart would give other tokens.  Byte-level tokens tile the record, so their lengths
give their spans.  Token spans and section spans are joined as sorted intervals.

A token that crosses a border is allocated by an explicit rule:
  start       to the section of its first byte
  majority    to the section with most of its bytes, the earlier one on a tie
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import blocks, table

RULES = ("start", "majority")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings; the encoder is built where it is used."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.encoder = None
        self.sizes = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "encoder": None, "sizes": None}

    def token_ends(self, text: str) -> np.ndarray:
        """End of every token of a whole text, in bytes."""
        if self.encoder is None:
            self.encoder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]
        return np.cumsum(self.sizes[self.encoder.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)])


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these cross a border.

    Tokens and sections each tile the same bytes; empty sections have no token.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(section_ends)
    starts = np.append(0, token_ends[:-1])[: len(token_ends)]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    chosen = first.copy()
    if rule == "majority":
        begins = np.append(0, section_ends[:-1])
        for i in crossing.tolist():
            parts = np.arange(first[i], last[i] + 1)
            shared = np.minimum(section_ends[parts], token_ends[i]) - np.maximum(begins[parts], starts[i])
            chosen[i] = parts[int(np.argmax(shared))]
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)


def attribute_tokens(records: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_crossing) for ``records(doc_id, sections)``.

    ``sections`` is an array of (name, text) that make the record end to end; one
    row comes out for each of them, empty ones with no token.  Null texts count as
    empty, a null array gives no row, null ids and repeated rows stay.
    """
    shared = records.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in blocks(batches, "text"):
            ids, names, chars, tokens, crossing = [], [], [], [], []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("lengths").to_pylist()):
                ends = np.cumsum([s["bytes"] for s in own])
                n, c = allocate(coder.token_ends(text), ends, rule)
                ids += [doc_id] * len(own)
                names += [s["section"] for s in own]
                chars += [s["chars"] for s in own]
                tokens.append(n)
                crossing.append(c)
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(chars, pa.int64()), join(tokens), join(crossing)], ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    safe = F.transform("sections", lambda s: F.struct(s["name"].alias("section"), F.coalesce(s["text"], F.lit("")).alias("text")))
    lengths = F.transform("safe", lambda s: F.struct(s["section"].alias("section"), F.octet_length(s["text"]).alias("bytes"), F.char_length(s["text"]).alias("chars")))
    rows = records.select("doc_id", safe.alias("safe")).where("size(safe) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(F.col("safe.text"), "").alias("text"), lengths.alias("lengths"))
    return rows.mapInArrow(run, "doc_id long, section string, n_chars long, n_tokens long, n_crossing long")


def document_records(docs: DataFrame) -> DataFrame:
    """Records of ``documents``: source, lang, the spaces between, the first line of the text and its rest."""
    text = F.coalesce("text", F.lit(""))
    # Where the first line ends, its line break included; a text without one is all first line.
    cut = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n")).otherwise(F.char_length(text))
    part = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("text"))
    gap = F.lit(" ")
    return docs.select("doc_id", F.array(part("source", F.col("source")), part("gap", gap), part("lang", F.col("lang")), part("gap 2", gap), part("first line", F.substring(text, F.lit(1), cut)), part("rest", F.substring(text, cut + 1, F.char_length(text)))).alias("sections"))


def op7_token_attribution(spark, sf_dir: str) -> DataFrame:
    return attribute_tokens(document_records(table(spark, sf_dir, "documents")))
