import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, awkward_docs, empty_docs, prose, rows

from combirisk.llm import filter_audit, lines


def sql(query, docs, labels=()):
    con = duckdb.connect()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    con.register("documents", pa.table([pa.array([r[i] for r in docs], k) for i, k in enumerate(kinds)], ["doc_id", "text", "lang", "source", "n_chars"]))
    con.register("labels", pa.table([pa.array([r[i] for r in labels], pa.int64()) for i in range(3)], ["doc_id", "quality", "toxic"]))
    return sorted(con.execute(query).fetchall(), key=str)


def shared_docs(draw, n, lines_of=8):
    """Documents of common and own lines, with copies, spaces at line ends and capitals."""
    common = [prose(draw, draw.randrange(1, 5)) for _ in range(12)]
    made = []
    for i in range(n):
        own = [draw.choice([draw.choice(common), draw.choice(common).upper() + " \t", prose(draw, 4), "", "  "]) for _ in range(draw.randrange(lines_of))]
        made.append((i, "\n".join(own), "en", draw.choice("ab"), 0))
    return made


def random_keys(n, seed):
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, size=(n, 2))


def test_cuckoo_filter_holds_what_was_added_and_not_deleted():
    keys = random_keys(20_000, 1)
    made = lines.CuckooFilter.sized(len(keys))
    made.add(keys[:12_000])
    made.add(keys[12_000:])
    assert made.holds(keys).all() and made.holds(random_keys(50_000, 2)).sum() == 0
    made.remove(keys[:15_000])
    assert made.holds(keys[15_000:]).all() and made.holds(keys[:15_000]).sum() == 0
    assert int((made.slots != 0).sum()) == 5_000
    with pytest.raises(ValueError):
        made.remove(keys[:1])
    # Too full a filter keeps the rest aside and stays right.
    small = lines.CuckooFilter(np.zeros((4, 4), np.uint32))
    small.add(keys[:40])
    assert len(small.aside) == 24 and small.holds(keys[:40]).all()
    small.remove(keys[:30])
    assert small.holds(keys[30:40]).all() and not small.holds(keys[:30]).any()


def held(index):
    return {tuple(r) for r in index.references.where("docs > 0").select("hi", "lo", "docs").collect()}


def test_insertions_and_deletions_leave_what_the_documents_give(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 6)
    monkeypatch.setattr(lines, "GROUP_BYTES", 40)
    # Marks of three bits make every second foreign key look like one of the filter's.
    places = lines.CuckooFilter._places
    monkeypatch.setattr(lines.CuckooFilter, "_places", lambda self, keys: (places(self, keys)[0] % 7 + 1, places(self, keys)[1]))
    draw = random.Random(4)
    data = shared_docs(draw, 120)
    frame = lambda part: spark.createDataFrame(part, DOCS)
    first = lines.LineIndex(spark, 10).insert(frame(data[:70]))
    both = first.insert(frame(data[70:]))
    assert both.shards > 1 and len(both._groups()) > 1
    assert sum(len(r["exceptions"] or []) for r in both.filters.collect()) > 0
    digest = lambda index, part: sorted(rows(index.clean(frame(part)).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept, 256)")), key=str)
    assert digest(both, data) == sql(lines.OP12_SQL, data)
    back = both.delete(frame(data[70:]))
    assert held(back) == held(first)
    assert digest(back, data[:70]) == digest(first, data[:70]) == sql(lines.OP12_SQL, data[:70])
    rest = both.delete(frame(data[:70]))
    assert digest(rest, data[70:]) == sql(lines.OP12_SQL, data[70:])
    with pytest.raises(ValueError):
        rest.delete(frame(data[:70]))


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup_of_awkward_rows(spark, extra):
    docs = awkward_docs(spark, extra)
    many = docs
    for _ in range(5):
        many = many.union(docs)
    found = lines.LineIndex(spark).insert(many).clean(many).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept, 256)")
    assert sorted(rows(found), key=str) == sql(lines.OP12_SQL, [r[:5] for r in rows(many)])
    kept = lines.drop_shared_lines(many)
    assert kept.columns == docs.columns and {r["text"] for r in kept.where("doc_id = 1 or doc_id is null").collect()} == {"", "another text under the same id", "no id at all for this text"}
    assert rows(lines.drop_shared_lines(empty_docs(spark))) == []


def test_trie_flags_all_but_the_smallest_id():
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab漢") for _ in range(draw.randrange(9))).encode() for _ in range(3000)]
    ids = [draw.randrange(5000) for _ in texts]
    trie = filter_audit.Trie()
    least = {}
    for row, (t, i) in enumerate(zip(texts, ids)):
        trie.insert(t, i, row)
        least[t] = min(least.get(t, i), i)
    assert set(trie.larger()) == {r for r, (t, i) in enumerate(zip(texts, ids)) if i > least[t]}
    assert trie.size <= sum(map(len, least))


def audited(docs, labels):
    return sorted(rows(filter_audit.audit(filter_audit.mask_counts(filter_audit.failure_masks(docs), labels))), key=str)


def test_audit_of_copies_over_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 3000)
    draw = random.Random(2)
    stem = prose(draw, 60)
    texts = [stem] * 80 + [stem + " " + prose(draw, 3) for _ in range(60)] + [prose(draw, draw.randrange(220)) for _ in range(60)] + ["word " * 250, "CAPITALS Here", "a # b", ""] * 3
    draw.shuffle(texts)
    data = [(draw.randrange(10**12), t, "en", draw.choice(["x", "y", None, ""]), 0) for t in texts]
    docs = spark.createDataFrame(data, DOCS)
    ranges = filter_audit.text_ranges(docs, 4)
    assert [p for p, _ in ranges] == sorted(p for p, _ in ranges) and len(ranges) > 10
    assert max(n for _, n in ranges) > 3
    labels = [(r[0], draw.randrange(2), draw.randrange(2)) for r in data[::2]]
    assert audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == sql(filter_audit.OP11_SQL, data, labels)


@pytest.mark.parametrize("extra", [False, True])
def test_audit_of_awkward_rows(spark, extra):
    docs = awkward_docs(spark, extra)
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (5, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs, frame) == sql(filter_audit.OP11_SQL, [r[:5] for r in rows(docs)], labels)
    assert audited(empty_docs(spark), frame) == []
