import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs, prose, rows

from combirisk.llm import suffix_dedup, suffixes


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                cut[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, x in zip(d, cut) if not x)
        spans = sum(1 for i, x in enumerate(cut) if x and (i == 0 or not cut[i - 1]))
        out.append((len(d), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    draw = random.Random(11)
    shared = prose(draw, 90)
    base = prose(draw, 300)
    texts = [prose(draw, 120) for _ in range(6)]
    texts += [prose(draw, 50) + shared + prose(draw, 40) for _ in range(12)]
    texts += [base, base]
    for _ in range(25):
        words = base.split()
        for _ in range(3):
            words[draw.randrange(len(words))] = "x" * draw.randrange(1, 9)
        texts.append(" ".join(words))
    texts += ["ab" * 400, "c" * 250, "c" * 200, "c" * 199, "d" * 201, ("schön " * 60) + prose(draw, 60), None, "", base[:205], base[3:203]]
    return texts


@pytest.mark.parametrize("bound", [4096, 7])
def test_matches_brute_force(spark, monkeypatch, bound):
    # A bound of 7 deals the anchors of the near copies over several shards.
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", bound)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1:5] for r in rows(suffix_dedup.remove_repeats(docs))}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_suffix_array_and_common_prefixes():
    draw = random.Random(4)
    for _ in range(30):
        text = bytes(draw.choice(b"ab") for _ in range(draw.randrange(9, 80)))
        keys = np.array([int.from_bytes((text + bytes(8))[i : i + 8], "big") for i in range(len(text))], np.uint64)
        order, starts = suffixes.first_groups(keys)
        heads = starts == np.arange(len(starts))
        suffixes.refine(order, starts, 8)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:] + b"\0")
        if heads.all():
            continue
        # Unique stops at the end keep prefixes inside the text.
        got = suffixes.kasai(list(text) + [256 + i for i in range(9)], order, heads, 0)
        for place in np.flatnonzero(~heads):
            a, b = text[order[place - 1] :], text[order[place] :]
            common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert got[place] == common


def test_strings_that_differ_in_two_digits_stay(spark):
    # The high bytes of two neighbouring 8-byte words: the old hash was the same for one pair in about 270.
    draw = random.Random(8)
    texts = []
    for _ in range(1500):
        base = bytearray(prose(draw, 60).encode()[:200])
        other = bytearray(base)
        for place in (167, 175):
            base[place], other[place] = draw.sample(b"0123456789", 2)
        texts += [base.decode(), other.decode()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).where("n_removed > 0").count() == 0


def test_awkward_rows(spark):
    found = rows(suffix_dedup.remove_repeats(awkward_docs(spark)).select("doc_id", "n_bytes", "n_removed"))
    assert len(found) == 10 and (None, 0, 0) in found
    docs = awkward_docs(spark, extra=True)
    long_copy = docs.where("doc_id = 5").selectExpr("cast(null as long) as doc_id", *[f"`{c}`" for c in docs.columns[1:]])
    stripped = suffix_dedup.strip_repeats(docs.unionByName(long_copy))
    assert stripped.columns == docs.columns
    got = rows(stripped.select("doc_id", "text", "n_chars"))
    assert (5, "", 0) in got and (None, "", 0) in got and (2, None, None) in got and len(got) == 11
    assert rows(suffix_dedup.remove_repeats(empty_docs(spark))) == []
    assert rows(suffix_dedup.strip_repeats(empty_docs(spark))) == []
