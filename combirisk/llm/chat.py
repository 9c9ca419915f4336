"""Chat formatting by columnar byte assembly, and the way back.

Every turn becomes ``[<kind>]`` escaped text ``[/<kind>]`` with a newline after it; a
conversation is its turns end to end.  Control strings are recognised by their first
character only, so three characters are escaped inside texts: ``[`` becomes ``~(``,
``]`` becomes ``~)``, and ``~`` becomes ``~~``.  An escaped text holds no bracket, no
text can imitate a mark, and reading backwards is one split on brackets.

Assembly works on columns: byte lengths of headers, texts and footers give cumulative
offsets, the offsets give scatter indices, and all bytes are copied into one buffer
that becomes an Arrow column without another copy.

Turns are sorted by (conversation, turn) over ranges, so a conversation of any length
may spread over several tasks; each gives one fragment with its order, and later folds
go through fragments one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import BLOCK_BYTES, stored, table, utf8

CONTROL = ((b"~", b"~~"), (b"[", b"~("), (b"]", b"~)"))
# The test conversation: texts that look like marks of well-known templates.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: bytes) -> bytes:
    for plain, safe in CONTROL:
        text = text.replace(plain, safe)
    return text


def unescape(text: bytes) -> bytes:
    if b"~" not in text:
        return text
    # Left to right over pairs, so that "~~(" is a tilde and a parenthesis.
    parts = text.split(b"~~")
    return b"~".join(p.replace(b"~(", b"[").replace(b"~)", b"]") for p in parts)


def header(role: str | None) -> bytes:
    return b"[" + escape((role or "").encode()) + b"]"


def footer(role: str | None) -> bytes:
    return b"[/" + escape((role or "").encode()) + b"]\n"


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices into ``source`` of all pieces, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def assemble(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave columns of byte strings row by row into one buffer.

    Each column is (bytes, starts, lengths).  Returns the buffer and the row ends.
    """
    lengths = np.stack([p[2] for p in pieces], axis=1)
    ends = np.cumsum(lengths.reshape(-1))
    places = (ends - lengths.reshape(-1)).reshape(rows, len(pieces))
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for i, (data, starts, sizes) in enumerate(pieces):
        read = gathered(data, starts, sizes)
        write = gathered(out, places[:, i], sizes)
        out[write] = data[read]
    return out, ends.reshape(rows, len(pieces))[:, -1] if rows else np.zeros(0, np.int64)


def _column(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths


def _dictionary(values: list[str | None], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of encoded strings with each distinct value stored once."""
    numbers: dict[str | None, int] = {}
    which = np.array([numbers.setdefault(v, len(numbers)) for v in values], np.int64)
    data, starts, lengths = _column([encode(v) for v in numbers])
    return data, starts[which], lengths[which]


def format_turns(roles: list[str | None], texts: list[bytes], conversations: np.ndarray, loss_role: str = "assistant") -> dict[str, pa.Array]:
    """Fragments of runs of one conversation: formatted text, number of turns, and byte spans under the loss mask."""
    n = len(roles)
    safe = _column([escape(t) for t in texts])
    data, ends = assemble([_dictionary(roles, header), safe, _dictionary(roles, footer)], n)
    fresh = np.ones(n, bool)
    fresh[1:] = conversations[1:] != conversations[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1
    offsets = np.append(0, ends[last]).astype(np.int32) if n else np.zeros(1, np.int32)
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    heads = np.array([len(header(r)) for r in roles], np.int64)
    begins = np.append(0, ends[:-1])
    owner = np.cumsum(fresh) - 1
    base = begins[first][owner] if n else begins[:0]
    masked = np.array([r == loss_role for r in roles], bool)
    spans = np.stack([begins + heads - base, begins + heads - base + safe[2]], axis=1)[masked] if n else np.zeros((0, 2), np.int64)
    per = np.bincount(owner[masked], minlength=len(first)) if n else np.zeros(0, np.int64)
    bounds = np.append(0, np.cumsum(per)).astype(np.int32)
    pair = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "stop"])
    return {"first": pa.array(first), "formatted": formatted, "n_turns": pa.array(last - first + 1), "loss": pa.ListArray.from_arrays(pa.array(bounds), pair)}


def _fragments(batches: Iterator[pa.RecordBatch], loss_role: str) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation within bounded pieces of a sorted partition."""
    for batch in batches:
        sizes = np.array([len(t) for t in utf8(batch.column("text"))], np.int64)
        ends = np.cumsum(sizes + 64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_BYTES, side="right")))
            part = batch.slice(start, stop - start)
            ids = part.column("conv_id").to_pylist()
            numbers: dict[int | None, int] = {}
            made = format_turns(part.column("role").to_pylist(), utf8(part.column("text")), np.array([numbers.setdefault(i, len(numbers)) for i in ids]), loss_role)
            place = pa.compute.take(part.column("place"), made["first"])
            yield pa.RecordBatch.from_arrays([pa.compute.take(part.column("conv_id"), made["first"]), place, made["formatted"], made["n_turns"], made["loss"]], ["conv_id", "place", "formatted", "n_turns", "loss"])
            start = stop


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, place, formatted, n_turns, loss): fragments of every conversation of ``turns(conv_id, turn, role, text)``.

    A conversation's fragments, in the order of ``place``, are its formatted text;
    most have one.  ``loss`` lists the byte spans of the masked texts.  Turns go by
    (turn, role, text), nulls first; null texts and roles count as empty, null
    conversation ids form one conversation, repeated rows stay, further columns are
    ignored.
    """
    keep = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # One number per row in sorted order: range partitions are in order, and so are the rows of each.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ranged = keep.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return ranged.mapInArrow(lambda b: _fragments(b, loss_role), "conv_id long, place long, formatted string, n_turns long, loss array<struct<start:long,stop:long>>")


def parse(formatted: bytes) -> list[tuple[str, bytes]]:
    """(role, text) of every turn of a formatted fragment."""
    turns = []
    pieces = formatted.split(b"[")
    for opening, closing in zip(pieces[1::2], pieces[2::2]):
        role, text = opening.split(b"]")
        if closing != b"/" + role + b"]\n":
            raise ValueError(f"unmatched mark {closing[:40]!r}")
        turns.append((unescape(role).decode(), unescape(text)))
    return turns


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of every conversation of a partition that comes sorted by (conv_id, place); one running state."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    done: list[tuple] = []

    def close() -> None:
        done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    for batch in batches:
        for conv_id, formatted, loss in zip(batch.column("conv_id").to_pylist(), utf8(batch.column("formatted")), batch.column("loss").to_pylist()):
            if state is None or state[0] != conv_id:
                if state is not None:
                    close()
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(role.encode() + b"\n" + text + b"\n")
            for span in loss:
                masked = unescape(formatted[span["start"] : span["stop"]])
                state[3] += len(masked.decode())
                state[4].update(masked)
            state[5] += len(formatted.decode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)
        done = []
    if state is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)


def read_back(fragments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted fragments."""
    dealt = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(_folded, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    # The formatted corpus is the result; the digests are read from it.
    return read_back(stored(format_conversations(turns.union(probe)), "chat"))


_ESCAPED = "replace(replace(replace({}, '~', '~~'), '[', '~('), ']', '~)')"
OP4_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as raw_role, text as raw_text from conversations
  union all select -1, 0, 'user', '{PROBE}', 'user', '{PROBE}'
  union all select -1, 1, 'assistant', '{PROBE}', 'assistant', '{PROBE}')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, raw_role nulls first, raw_text nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, raw_text nulls first) filter (role = 'assistant'), '')) as loss_sha256,
       sum(2 * length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 6)::bigint as formatted_chars
from turns group by conv_id
"""
