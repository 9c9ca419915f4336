import random

from helpers import DOCS, awkward_docs, empty_docs, prose, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from combirisk.llm import near_copies


def similarity(one, two):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (one, two))
    return len(x & y) / len(x | y)


def edited(draw, text, changes):
    words = text.split()
    for at in draw.sample(range(len(words)), changes):
        words[at] = draw.choice(("changed", "other", "words")) + str(draw.randrange(1000))
    return " ".join(words)


def test_recall_of_near_copies_against_brute_force(spark):
    """Pairs at 0.8 and more are found with a recall of at least 0.9, and nothing below 0.8 is linked."""
    draw = random.Random(6)
    texts = []
    for _ in range(60):
        base = prose(draw, draw.randrange(60, 300))
        texts.append(base)
        for _ in range(3):
            texts.append(edited(draw, base, draw.randrange(1, max(2, len(base.split()) // 35))))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    wanted = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i // 4 == j // 4 and similarity(texts[i], texts[j]) >= 0.8}
    keys, links = near_copies.near_links(docs)
    of = {r["key"]: r["node"] for r in keys.collect()}
    node = {r["doc_id"]: of[r["key"]] for r in docs.select("doc_id", near_copies.text_key("text").alias("key")).collect()}
    found = {frozenset(r) for r in rows(links)}
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if node[i] == node[j] or frozenset((node[i], node[j])) in found}
    assert len(wanted) > 100 and len(wanted & near) >= 0.9 * len(wanted)
    assert all(similarity(texts[i], texts[j]) >= 0.8 for i, j in near)


def test_a_large_group_keeps_one(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRED", 4)
    draw = random.Random(2)
    base = prose(draw, 220)
    data = [(10 + i, base if i % 3 == 0 else edited(draw, base, 2), "en", "a", 0) for i in range(150)] + [(500 + i, prose(draw, 80), "en", "b", 0) for i in range(20)]
    kept = {r["doc_id"] for r in near_copies.keep_first(spark.createDataFrame(data, DOCS)).collect()}
    assert kept == {10, *range(500, 520)}


def test_awkward_rows(spark):
    for extra in (False, True):
        docs = awkward_docs(spark, extra)
        kept = near_copies.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert rows(near_copies.keep_first(empty_docs(spark))) == []


def test_every_similar_pair_of_a_long_list_is_connected(spark, monkeypatch):
    """Texts that differ from the first of their long list stay linked with each other, and no candidate is dropped before its texts are compared."""
    monkeypatch.setattr(near_copies, "PAIRED", 4)
    monkeypatch.setattr(near_copies, "TILE", 8)
    # All texts meet in one list, whatever they share.
    monkeypatch.setattr(near_copies, "_lists", lambda nodes: nodes.select(F.lit(0).alias("place"), F.lit(0).alias("value"), "node", F.lit(60).cast("long").alias("members"), F.min("node").over(Window.partitionBy()).alias("first")))
    draw = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(draw, 150)
        texts += [base, *[edited(draw, base, 2) for _ in range(4)]]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if similarity(texts[i], texts[j]) >= 0.8}
    kept = {r["doc_id"] for r in near_copies.keep_first(docs).collect()}
    groups = {i: i for i in range(60)}
    for i, j in sorted(wanted):
        low, high = sorted((groups[i], groups[j]))
        groups = {k: low if g == high else g for k, g in groups.items()}
    assert len(wanted) > 60 and kept == set(groups.values())
