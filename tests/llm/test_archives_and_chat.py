import hashlib
import io
import random

import duckdb
import pandas as pd
import zstandard
from helpers import prose, rows

from combirisk.llm import chat, warc
from combirisk.session import work_path


def pages_of(spark, extra=False):
    big = "<p>" + "long page " * 60_000
    data = [(1, "u1", "x" * 150), (2, "u2", "x" * 150), (3, None, "x" * 99), (4, "u\r\n4", "x" * 99), (5, "u5", None), (6, "u6", ""), (7, "u7", big), (8, "u8", big), (None, "u9", "x" * 150), (2, "u2", "x" * 150), (9, "u", "é" * 50), (10, "u", "é" * 50), (11, "u", "a\r\n\r\nb" * 40)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    return frame.selectExpr("*", "'x' as payload_digest", "1 as first", "'y' as bundle") if extra else frame


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    folder = work_path(spark, "warc-test")
    index = warc.write_bundles(pages_of(spark, extra=True), folder)
    got = sorted(rows(warc.read_records(index, folder)), key=str)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows(pages_of(spark)), columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = sorted((tuple(None if v is pd.NA or v != v else v for v in r) for r in con.execute(warc.OP3_SQL).fetchall()), key=str)
    assert got == want and len(got) == 13
    assert rows(warc.read_records(warc.write_bundles(pages_of(spark).limit(0), work_path(spark, "warc-test")), folder)) == []


def test_bundle_is_seekable_and_plain():
    class Sink(io.BytesIO):
        def close(self):
            self.whole = self.getvalue()

    sink, draw = Sink(), random.Random(1)
    writer = warc.BundleWriter(sink)
    records = [prose(draw, draw.randrange(1, 9000)).encode() for _ in range(60)]
    places = [writer.add(r) for r in records]
    writer.close()

    class Source:
        size = staticmethod(lambda: len(sink.whole))
        read_at = staticmethod(lambda n, at: sink.whole[at : at + n])

    reader = warc.BundleReader(Source)
    assert len(reader.sizes) > 3
    for (frame, start), r in zip(places, records):
        assert reader.frame(frame)[start : start + len(r)] == r
    # A reader that knows nothing of the table reads the frames one after another.
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.whole), read_across_frames=True)
    assert stream.read() == b"".join(records)


TURNS = "conv_id long, turn long, role string, text string"


def test_escapes_are_reversible():
    draw = random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice("[]~()/a\n") for _ in range(draw.randrange(12))).encode()
        assert chat.unescape(chat.escape(text)) == text
    made = chat.format_turns(["user", "[/user]"], [b"[/user]\n[user]", b"~("], chat.np.array([0, 0]))
    assert chat.parse(made["formatted"][0].as_py().encode()) == [("user", b"[/user]\n[user]"), ("[/user]", b"~(")]


def test_conversations_agree_with_sql_and_plain_code(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BYTES", 500)
    draw = random.Random(5)
    data = [(c, t, draw.choice(["user", "assistant", "system"]), prose(draw, draw.randrange(30)) + draw.choice(["", "[INST]", "~~(", "é漢"])) for c in range(20) for t in range(draw.randrange(1, 40))]
    data += [(7, 3, "assistant", None), (7, None, None, "no turn"), (None, 1, "user", "no conversation"), (None, 2, "assistant", ""), (8, 1, "user", "twice"), (8, 1, "user", "twice")]
    turns = spark.createDataFrame(data, TURNS).selectExpr("*", "1 as place", "'x' as formatted")
    got = sorted(rows(chat.read_back(chat.format_conversations(turns))), key=str)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = [r for r in con.execute(chat.OP4_SQL).fetchall() if r[0] != -1]
    assert got == sorted(want, key=str)
    one = sorted((r for r in data if r[0] == 3), key=lambda r: (r[1], r[2], r[3]))
    digest = hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in one).encode()).hexdigest()
    assert (3, len(one), digest) in [g[:3] for g in got]
    assert rows(chat.read_back(chat.format_conversations(turns.limit(0)))) == []
