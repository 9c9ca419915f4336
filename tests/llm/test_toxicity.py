import random

import numpy as np
from helpers import awkward_docs, empty_docs, prose, rows

from combirisk.llm import toxicity


def plain_segments(scores):
    """Best segment, then the best of what lies left and right of it, and so on."""
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j)
        if best:
            out.append(best[1:])
            split(a, best[1])
            split(best[2] + 1, b)

    split(0, len(scores))
    return sorted(out)


def test_segments_match_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        scores = [draw.choice([-3.1, -1.7, -0.9, 0.8, 1.3, 2.9]) + draw.random() / 100 for _ in range(draw.randrange(25))]
        assert [s[:2] for s in toxicity.maximal_segments(np.array(scores))] == plain_segments(scores)


def test_extreme_value_law_is_recovered():
    draw = np.random.default_rng(1)
    n = draw.integers(50, 500, 4000)
    best = (np.log(0.2 * n) - np.log(-np.log(draw.random(4000)))) / 1.5
    rate, scale = toxicity.extreme_value_law(best, n.astype(float))
    assert abs(rate - 1.5) < 0.1 and abs(scale - 0.2) < 0.05


def labelled(spark, n=600):
    draw = random.Random(9)
    data = []
    for i in range(n):
        words = prose(draw, draw.randrange(40, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words.insert(draw.randrange(len(words)), draw.choice(["grumblex", "snarfly", "viletype"]))
        data.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_held_out_accuracy_and_passages(spark):
    docs, labels = labelled(spark)
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    fold = [r for r in scored.withColumn("out", toxicity.held_out(toxicity.F.col("doc_id"))).collect() if r["out"]]
    assert len(fold) > 100
    assert all((r["score"] >= 0.7) == bool(r["toxic"]) for r in fold if r["toxic"]) and sum(r["score"] >= 0.7 for r in fold if not r["toxic"]) == 0
    assert all(r["segments"] for r in fold if r["toxic"])


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark, 200)
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 100)
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.score_documents(awkward_docs(spark, extra=True), model).select("doc_id", "score"))
    assert len(got) == 10 and all(0 <= s <= 1 for _, s in got)
    kept = toxicity.drop_toxic(awkward_docs(spark, extra=True), model)
    assert kept.count() == 10 and kept.columns == awkward_docs(spark, extra=True).columns
    # Nothing to learn from: every score is low.
    nothing = toxicity.fit(empty_docs(spark), labels.limit(0))
    assert nothing.odds == {} and all(s < 0.7 for _, s in rows(toxicity.score_documents(docs, nothing).select("doc_id", "score")))
    assert rows(toxicity.score_documents(empty_docs(spark), model)) == []
