"""Repair of conversation structure: cheapest edits that give ``(s?(ua)+)?``, by streaming over sorted turns.

Rows are dealt by conversation and sorted by turn; one pass carries the state of a
dynamic program from Arrow batch to Arrow batch.  Its four states say what the
repaired conversation ends with so far: nothing, a system turn, a user turn, an
assistant turn.  A row is kept (0), given the role that is due (1) or deleted (2,
the only way for blank and repeated rows); empty turns may be inserted (5 each); a
truncated row that stays adds 5.

Of edits of equal cost the least string of initials wins.  Right after a row all
candidate strings hold the same number of letters other than I and end in one, so
none is the start of another; their order is settled and a rank for each state
carries it.  So a row leaves four bytes behind, one for each state: the state
before, the insertions, the edit.  Beyond ``SPILL_BYTES`` those bytes and the rows
go to a temporary file of the task; a conversation of any length needs bounded
memory, and a lost task starts again from its input.

Whether a row repeats an earlier one is found before: the first turn of every
(conversation, role, text) is a grouped minimum, and it travels in the same sorted
stream as a marker in front of the row it stands for.  So no task holds the texts
that it has seen.

Defined results: null roles and texts count as one space (such a row is blank or
gets a new role), null turns come first, null ids form one conversation, rows of
one turn go by role and MD5 of their text, repeated rows are duplicates, further
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combirisk.llm.common import table

# Bytes of one conversation's rows, and of its back pointers, that stay in memory; a multiple of 4.
SPILL_BYTES = 8 << 20
# Rows and characters of one pandas frame that a task gives out.
FRAME_ROWS, FRAME_CHARS = 4096, 4 << 20

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {"su", "ua", "au"}
DUE = ("user", "user", "assistant", "user")
AFTER_DUE = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
LETTERS = "DKR"


def _inserted(state: int, most: int = 2) -> Iterator[tuple[int, int]]:
    """(state, insertions); a third insertion would only come back to a state that one reaches."""
    yield state, 0
    for n in range(1, most + 1):
        state = AFTER_DUE[state]
        yield state, n


def _moves(initial: str, deleted: bool, truncated: bool) -> list[list[tuple[int, int, str, int]]]:
    """For each state after a row of this kind: (state before, cost, letters, packed), the best from each state."""
    best: dict[tuple[int, int], tuple[int, str, int]] = {}
    for before in range(4):
        for state, n in _inserted(before):
            options = [(state, DELETE_COST, 0)]
            if not deleted:
                extra = TRUNCATED_COST if truncated else 0
                if (state, initial) in KEPT:
                    options.append((KEPT[state, initial], extra, 1))
                options.append((AFTER_DUE[state], REROLE_COST + extra, 2))
            for after, cost, edit in options:
                found = (cost + INSERT_COST * n, "I" * n + LETTERS[edit], before | n << 2 | edit << 4)
                best[before, after] = min(best.get((before, after), found), found)
    return [[(b, *best[b, after]) for b in range(4) if (b, after) in best] for after in range(4)]


MOVES = {(i, d, t): _moves(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}
DEAD = 255


class _Pointers:
    """Four bytes a row, the later blocks in memory and the earlier ones in a file."""

    def __init__(self) -> None:
        self.tail, self.file, self.blocks = bytearray(), None, 0

    def add(self, quad: bytes) -> None:
        self.tail += quad
        if len(self.tail) >= SPILL_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(self.tail)
            self.tail, self.blocks = bytearray(), self.blocks + 1

    @staticmethod
    def _walk(block: bytes, state: int) -> tuple[bytearray, int]:
        codes = bytearray(len(block) // 4)
        for i in range(len(codes) - 1, -1, -1):
            codes[i] = block[4 * i + state]
            state = codes[i] & 3
        return codes, state

    def chosen(self, state: int) -> Iterator[int]:
        """The packed edits on the way to ``state``, first row first; back through the blocks, then forward."""
        last, state = self._walk(self.tail, state)
        size = SPILL_BYTES // 4
        for b in range(self.blocks - 1, -1, -1):
            self.file.seek(b * SPILL_BYTES)
            codes, state = self._walk(self.file.read(SPILL_BYTES), state)
            # The block is read; its edits take a quarter of its place.
            self.file.seek(b * SPILL_BYTES)
            self.file.write(codes)
        for b in range(self.blocks):
            self.file.seek(b * SPILL_BYTES)
            yield from self.file.read(size)
        yield from last


class _Rows:
    """Rows of one conversation in order, the earlier ones in a file."""

    def __init__(self) -> None:
        self.tail, self.held, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.tail.append((role, text))
        self.held += len(text) + 64
        if self.held >= SPILL_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.tail, self.file)
            self.tail, self.held = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.tail


class _Conversation:
    """Forward state of one conversation; ``edits`` after its last row."""

    def __init__(self, conv: int, no_conv: bool) -> None:
        self.conv, self.no_conv, self.rows, self.pointers = conv, no_conv, _Rows(), _Pointers()
        self.costs, self.ranks = [0, None, None, None], [0, 0, 0, 0]
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before = None
        self.fresh = False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if fault != BLANK and not self.fresh:
            fault = DUPLICATE
        self.fresh = False
        self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        costs, ranks, found = self.costs, self.ranks, []
        for moves in MOVES[initial if initial in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE), fault == TRUNCATED]:
            best = None
            for before, cost, letters, packed in moves:
                if costs[before] is not None:
                    option = (costs[before] + cost, ranks[before], letters, packed)
                    if best is None or option < best:
                        best = option
            found.append(best)
        order = sorted((f[1], f[2]) for f in found if f)
        self.costs = [f and f[0] for f in found]
        self.ranks = [order.index((f[1], f[2])) if f else 0 for f in found]
        self.pointers.add(bytes(f[3] if f else DEAD for f in found))
        self.rows.add(role, text)

    def summary(self) -> tuple[int, ...]:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[BLANK:], self.illegal, self._end()[0])

    def _end(self) -> tuple[int, int, int, int]:
        """(cost, rank, insertions, state) of the best way to close."""
        ways = [(self.costs[s] + INSERT_COST * n, self.ranks[s], n, s) for s in range(4) if self.costs[s] is not None for after, n in _inserted(s) if after in ENDS]
        return min(ways)

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired conversation; deleted rows show what they were."""
        _, _, closing, end = self._end()
        state = 0
        for code, (role, text) in zip(self.pointers.chosen(end), self.rows):
            for _ in range(code >> 2 & 3):
                yield "I", DUE[state], ""
                state = AFTER_DUE[state]
            edit = LETTERS[code >> 4]
            if edit == "R":
                role = DUE[state]
            if edit != "D":
                state = KEPT[state, role[0]]
            yield edit, role, text
        for _ in range(closing):
            yield "I", DUE[state], ""
            state = AFTER_DUE[state]


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
ROW, FIRST, ID = 2, 1, 0


def _rows_of(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(frame[n].tolist() for n in names))


def _framed(rows: Iterator[tuple], names: list[str], weigh: int) -> Iterator[pd.DataFrame]:
    """Frames of bounded size; ``weigh`` is the place of the column that holds text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[weigh] or "")
        if len(held) >= FRAME_ROWS or chars >= FRAME_CHARS:
            yield pd.DataFrame(held, columns=names)
            held, chars = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


REPAIRED = "conv long, no_conv boolean, place long, edit string, role string, text string, " + ", ".join(f"{n} long" for n in SUMMARY)
REPAIRED_NAMES = ["conv", "no_conv", "place", "edit", "role", "text", *SUMMARY]


def _closed(one: _Conversation) -> Iterator[tuple]:
    nothing = (0,) * len(SUMMARY)
    yield (one.conv, one.no_conv, 0, None, None, None, *one.summary())
    for place, (edit, role, text) in enumerate(one.edits(), 1):
        yield (one.conv, one.no_conv, place, edit, role, text, *nothing)


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        one = None
        for conv, no_conv, turn, no_turn, role, text, fault, mark in _rows_of(frames, ["conv", "no_conv", "turn", "no_turn", "role", "text", "fault", "mark"]):
            if one is None or (one.conv, one.no_conv) != (conv, no_conv):
                if one is not None:
                    yield from _closed(one)
                one = _Conversation(conv, no_conv)
            if mark == FIRST:
                one.fresh = True
            elif mark == ROW:
                one.add(None if no_turn else turn, role, text, fault)
        if one is not None:
            yield from _closed(one)

    return _framed(rows(), REPAIRED_NAMES, 5)


def _fault(text: Column) -> Column:
    """Blank or truncated; repeats are found later."""
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    cut = ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(0)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Repaired conversations of ``turns(conv_id, turn, role, text)``.

    Place 0 of a conversation has its summary (gaps, blank, duplicate, truncated,
    illegal, cost); places from 1 have one edit each (K keep, R new role, D delete,
    I insert) with the role and text that it leaves, or deletes.  ids of
    ``conversations(conv_id)`` without a turn get a summary of zeros.  Rows of a
    conversation come out together and in order.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.md5("text"))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    nothing = F.lit(None).cast("string")
    stream = rows.select("conv_id", "turn", "role", "text", "digest", _fault(F.col("text")).alias("fault"), F.lit(ROW).alias("mark")).unionByName(
        firsts.select("conv_id", "turn", "role", nothing.alias("text"), "digest", F.lit(0).alias("fault"), F.lit(FIRST).alias("mark"))
    )
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        stream = stream.unionByName(ids.select("conv_id", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), nothing.alias("digest"), F.lit(0).alias("fault"), F.lit(ID).alias("mark")))
    # No nullable long goes through pandas, which would make it a double.
    flat = stream.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.isnull("conv_id").alias("no_conv"), F.coalesce("turn", F.lit(0)).alias("turn"), F.isnull("turn").alias("no_turn"), "role", "text", "digest", "fault", "mark"
    )
    dealt = flat.repartition("conv", "no_conv").sortWithinPartitions("conv", "no_conv", F.col("no_turn").desc(), "turn", F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), "mark").drop("digest")
    named = dealt.mapInPandas(_repaired, REPAIRED)
    head = F.col("place") == 0
    return named.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "place", "edit", "role", "text", *[F.when(head, F.col(n)).alias(n) for n in SUMMARY])


DIGESTS = "conv long, no_conv boolean, " + ", ".join(f"{n} long" for n in SUMMARY) + ", audit string, repaired_sha256 string"
DIGEST_NAMES = ["conv", "no_conv", *SUMMARY, "audit", "repaired_sha256"]


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        head, audit, digest, empty = None, [], hashlib.sha256(), True
        for conv, no_conv, place, edit, role, text, *summary in _rows_of(frames, REPAIRED_NAMES):
            if place == 0:
                if head is not None:
                    yield (*head, "".join(audit), digest.hexdigest())
                head, audit, digest, empty = (conv, no_conv, *map(int, summary)), [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if head is not None:
            yield (*head, "".join(audit), digest.hexdigest())

    return _framed(rows(), DIGEST_NAMES, 8)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, summary, audit, repaired_sha256): one row a conversation from what ``repair`` gives, in its order."""
    flat = repaired.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.isnull("conv_id").alias("no_conv"), "place", "edit", "role", "text", *[F.coalesce(n, F.lit(0)).alias(n) for n in SUMMARY])
    made = flat.mapInPandas(_digested, DIGESTS)
    return made.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), *SUMMARY, "audit", "repaired_sha256")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes
    its ``.!?`` out, 3 repeats it, 4 sets role user.  Nulls of any column count as one space."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    hit = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "utf-8")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    shown = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), shown.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(repair(damage(turns), turns.select("conv_id")))


_CODES = "list_transform(string_split({}, ''), lambda c: ascii(c)::bigint)"
_BITS = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda rest, step: xor(rest >> 1, 3988292384 * (rest & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, {_CODES.format('{}')}), lambda crc, byte: {_BITS}), 4294967295)"
OP13_SQL = f"""
with recursive given as (
  select dense_rank() over (order by conv_id nulls first) as c, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as hit
  from conversations),
damaged as (
  select c, turn, case when hit = 4 then 'user' else role end as role,
         case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when hit = 3 then 2 else 1 end)) as copy
  from given where hit <> 0),
numbered as (
  select c, turn, role, text,
         row_number() over (partition by c order by turn nulls first, role, md5(text), copy) as i,
         case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
              when row_number() over (partition by c, role, text order by turn nulls first, copy) > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else 'none' end as fault,
         lag(role) over (partition by c order by turn nulls first, role, md5(text), copy) as role_before
  from damaged),
inserts(before, state, cost, letters, made) as (
  values (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (2, 2, 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
         (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:'), (3, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
steps(edit, state, initial, after, due) as (
  values ('D', 0, null, 0, null), ('D', 1, null, 1, null), ('D', 2, null, 2, null), ('D', 3, null, 3, null),
         ('K', 0, 's', 1, null), ('K', 0, 'u', 2, null), ('K', 1, 'u', 2, null), ('K', 2, 'a', 3, null), ('K', 3, 'u', 2, null),
         ('R', 0, null, 2, 'user'), ('R', 1, null, 2, 'user'), ('R', 2, null, 3, 'assistant'), ('R', 3, null, 2, 'user')),
path(c, i, state, best) as (
  select distinct c, 0::bigint, 0, {{'cost': 0, 'audit': '', 'made': ''}} from given
  union all
  select p.c, n.i, s.after, min({{
    'cost': p.best.cost + k.cost + case s.edit when 'D' then 2 when 'R' then 1 else 0 end + case when s.edit <> 'D' and n.fault = 'truncated' then 5 else 0 end,
    'audit': p.best.audit || k.letters || s.edit,
    'made': p.best.made || k.made || case s.edit when 'D' then '' else chr(10) || coalesce(s.due, n.role) || ':' || n.text end}})
  from path p join numbered n on n.c = p.c and n.i = p.i + 1 join inserts k on k.before = p.state
  join steps s on s.state = k.state and (s.edit <> 'K' or s.initial = left(n.role, 1)) and (s.edit = 'D' or n.fault not in ('blank', 'duplicate'))
  group by p.c, n.i, s.after),
counts as (
  select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where role_before is not null and left(role_before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from numbered group by c),
closed as (
  select p.c, min({{'cost': p.best.cost + k.cost, 'audit': p.best.audit || k.letters, 'made': p.best.made || k.made}}) as best
  from path p left join counts n on n.c = p.c join inserts k on k.before = p.state
  where p.i = coalesce(n.n, 0) and k.state in (0, 3) group by p.c)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, best.cost::bigint as cost, best.audit as audit, sha256(substr(best.made, 2)) as repaired_sha256
from (select distinct c, conv_id from given) g join closed using (c) left join counts using (c)
"""
