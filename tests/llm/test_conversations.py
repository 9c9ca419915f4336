import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from helpers import rows

from combirisk.llm import conversations

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit) over all edits of (role initial, must go, truncated) turns, by trying everything."""
    best = None
    n = len(turns)
    for edits in itertools.product("DKR", repeat=n):
        if any(t[1] and e != "D" for t, e in zip(turns, edits)):
            continue
        base = sum({"D": 2, "R": 1, "K": 0}[e] + (5 if t[2] and e != "D" else 0) for t, e in zip(turns, edits))
        for inserts in itertools.product(range(3), repeat=n + 1):
            cost = base + 5 * sum(inserts)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * k + e for k, e in zip(inserts, edits)) + "I" * inserts[-1]
            # What the strings leave: u and a where due, kept roles must fit.
            state, kept = 0, iter(t[0] for t, e in zip(turns, edits))
            for letter in audit:
                if letter != "I":
                    initial = next(kept)
                if letter == "D":
                    continue
                due = "uuau"[state]
                if letter == "K":
                    if initial != due and not (state == 0 and initial == "s"):
                        state = None
                        break
                    due = initial
                state = {"s": 1, "u": 2, "a": 3}[due]
            if state in (0, 3):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_edits_are_the_cheapest_and_least():
    draw = random.Random(3)
    for case in range(150):
        turns = [(draw.choice("suaau"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(draw.randrange(5))]
        one = conversations._Conversation(1, False)
        for i, (initial, gone, cut) in enumerate(turns):
            one.fresh = True
            one.add(i, {"s": "system", "u": "user", "a": "assistant"}[initial], "" if gone else f"text {i}", conversations.BLANK if gone else conversations.TRUNCATED if cut else 0)
        assert (one.summary()[-1], "".join(e for e, _, _ in one.edits())) == cheapest(turns), turns


def test_spilled_conversations_give_the_same(monkeypatch):
    def made(limit):
        monkeypatch.setattr(conversations, "SPILL_BYTES", limit)
        draw = random.Random(9)
        one = conversations._Conversation(1, False)
        for i in range(3000):
            one.fresh = draw.random() < 0.9
            one.add(i // 2, draw.choice(["system", "user", "assistant", "tool", ""]), "t" * draw.randrange(9), draw.choice([0, 0, 0, conversations.TRUNCATED]))
        spilled = one.pointers.blocks
        return spilled, one.summary(), list(one.edits())

    kept, small = made(1 << 20), made(256)
    assert kept[0] == 0 and small[0] > 40
    assert kept[1:] == small[1:]


AWKWARD = [
    (None, 1, "user", "No conversation."), (None, None, None, None), (7, 3, "assistant", None), (7, None, None, "No turn."), (7, None, "user", "No turn."),
    (8, 1, "user", "Twice."), (8, 1, "user", "Twice."), (8, 2, "", "No role"), (8, -4, "user", " \n"), (9, 0, "tool", "ünï 漢字 " * 9000), (9, 1, "userland", "Kept?"),
    (10, 1, "user", "Same text."), (10, 5, "user", "Same text."), (10, 6, "assistant", "Same text."), (11, 1, "assistant", "End…"), (2**60 + 1, 2**60, "user", "Large ids."),
]


@pytest.mark.parametrize("extra", [False, True])
def test_agrees_with_sql_on_awkward_and_drawn_rows(spark, monkeypatch, extra):
    monkeypatch.setattr(conversations, "FRAME_ROWS", 7)
    draw = random.Random(5)
    data = AWKWARD + [
        (c, draw.randrange(40), draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["One.", "Two!", "cut", " ", "", "Why?\n", "a.b", "漢"]) * draw.randrange(1, 3))
        for c in range(20, 60)
        for _ in range(draw.randrange(1, 16))
    ]
    turns = spark.createDataFrame(data, TURNS)
    if extra:
        turns = turns.selectExpr("*", "1 as conv", "'x' as digest", "2 as mark", "3 as hit", "false as no_conv")
    got = sorted(rows(conversations.digests(conversations.repair(conversations.damage(turns), turns))), key=str)
    con = duckdb.connect()
    con.register("conversations", pa.table([pa.array([r[i] for r in data], pa.int64() if i < 2 else pa.string()) for i in range(4)], ["conv_id", "turn", "role", "text"]))
    assert got == sorted(con.execute(conversations.OP13_SQL).fetchall(), key=str)


def test_repaired_rows_and_empty_tables(spark):
    data = [(1, 1, "assistant", "Hello."), (1, 2, "user", "So"), (1, 3, "user", "So."), (2, 1, "user", "")]
    turns = spark.createDataFrame(data, TURNS)
    out = rows(conversations.repair(turns).orderBy("conv_id", "place"))
    assert out[0] == (1, 0, None, None, None, 0, 0, 0, 1, 1, 4)
    assert [r[2:5] for r in out[1:4]] == [("R", "user", "Hello."), ("D", "user", "So"), ("R", "assistant", "So.")]
    assert out[4:] == [(2, 0, None, None, None, 0, 1, 0, 0, 0, 2), (2, 1, "D", "user", "", *[None] * 6)]
    assert rows(conversations.digests(conversations.repair(turns.limit(0)))) == []
    # An id without any turn has zeros and the hash of nothing.
    ids = spark.createDataFrame([(5,)], "conv_id long")
    assert rows(conversations.digests(conversations.repair(turns.limit(0), ids))) == [(5, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]
