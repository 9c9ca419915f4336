import random

import xxhash
from helpers import awkward_docs, empty_docs, prose, rows

from combirisk.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_fingerprints_and_groups_match_brute_force(spark):
    draw = random.Random(5)
    texts = []
    for _ in range(40):
        base = prose(draw, draw.randrange(1, 60)).split()
        texts.append(" ".join(base))
        for _ in range(draw.randrange(4)):
            copy = list(base)
            copy[draw.randrange(len(copy))] = "Changed"
            texts.append("  ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want_fp = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    root = plain_groups(set(want_fp.values()))
    least = {}
    for i, f in want_fp.items():
        least[root[f]] = min(least.get(root[f], i), i)
    got = {r[0]: (r[2] & (1 << 64) - 1, r[3]) for r in rows(simhash.near_duplicates(docs))}
    assert got == {i: (f, least[root[f]]) for i, f in want_fp.items()}


def test_long_lists_are_linked_exactly(spark):
    draw = random.Random(6)
    centre = draw.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for _ in range(300)}
    fps |= {draw.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_groups(fps)
    for limit in (2, 16, 1000):
        got = {a & (1 << 64) - 1: b & (1 << 64) - 1 for a, b in rows(simhash.connected(simhash.links(frame, limit)))}
        classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert classes({f: got.get(f, f) for f in fps}) == classes(want)


def test_awkward_rows(spark):
    found = rows(simhash.near_duplicates(awkward_docs(spark)))
    assert len(found) == 10
    # Null, empty and blank texts share fingerprint zero and one group.
    assert {r[3] for r in found if r[2] == 0} == {2}
    kept = rows(simhash.keep_first(awkward_docs(spark, extra=True)).select("doc_id", "text"))
    assert len(kept) == 6 and sum(k[0] == 1 for k in kept) == 2
    assert (2, None) in kept or (None, None) in kept
    assert simhash.keep_first(awkward_docs(spark, extra=True)).columns == awkward_docs(spark, extra=True).columns
    assert rows(simhash.near_duplicates(empty_docs(spark))) == []
    assert rows(simhash.keep_first(empty_docs(spark))) == []
