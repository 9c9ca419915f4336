import random

import pytest
from helpers import awkward_docs, empty_docs, prose, rows

from combirisk.llm import decontamination as D


def index_of(items):
    index = D.BlockMaxIndex()
    for i, t in enumerate(items):
        index.add(i, t)
    return index.close()


def test_search_matches_full_scoring():
    draw = random.Random(8)
    index = index_of([prose(draw, draw.randrange(3, 150)) for _ in range(90)])
    for _ in range(200):
        terms = sorted({index.terms[w] for w in D.words(prose(draw, draw.randrange(1, 60))) if w in index.terms})
        scores = {}
        for t in terms:
            for chunk, weight in zip(index.postings[t].chunks.tolist(), index.postings[t].weights.tolist()):
                scores[chunk] = scores.get(chunk, 0.0) + weight
        for threshold in (0.2, 0.4, 0.7):
            want = {c for c, s in scores.items() if s >= threshold}
            assert {c for c, _ in index.search(terms, threshold)} == want if terms else not want


def test_bounds_lose_no_window():
    draw = random.Random(12)
    items = [prose(draw, draw.randrange(5, 80)) for _ in range(60)]
    index = index_of(items)
    texts = [D.words(prose(draw, 40) + " " + items[i % 60] + " " + prose(draw, draw.randrange(300))) for i in range(40)]
    found = D.candidates(index, index.bounds(), texts, 0.5)
    for tokens, hits in zip(texts, found):
        want = set()
        for a, b in D._windows(len(tokens)):
            terms = sorted({index.terms[w] for w in tokens[a:b] if w in index.terms})
            want |= {(index.chunk_item[c], a, b) for c, _ in index.search(terms, 0.5)}
        assert {h[:3] for h in hits} == want and want


@pytest.mark.parametrize("shard_chars", [500_000, 400])
def test_planted_items_are_found(spark, shard_chars):
    draw = random.Random(3)
    items = [f"{prose(draw, draw.randrange(8, 90))}. {prose(draw, draw.randrange(1, 12))}." for _ in range(20)]
    texts, want = [], set()
    for i in range(120):
        parts = [prose(draw, draw.randrange(0, 400))]
        if i % 4 == 0:
            parts += [items[i % 20].upper() if i % 8 else items[i % 20], prose(draw, 50)]
            want.add((i, i % 20))
        elif i % 4 == 1:
            parts += [items[i % 20][: len(items[i % 20]) // 3], prose(draw, 30)]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r[:2] for r in rows(D.contaminated(docs, benchmark, shard_chars=shard_chars).select("doc_id", "item_id"))} == want
    kept = D.drop_contaminated(docs, benchmark, shard_chars=shard_chars)
    assert {r[0] for r in rows(kept)} == set(range(120)) - {d for d, _ in want}


def test_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "no id at all for this text"), (3, "one two three four five six seven eight")], "item_id long, text string")
    found = rows(D.contaminated(awkward_docs(spark, extra=True), benchmark).select("doc_id", "item_id"))
    assert sorted(found, key=str) == sorted([(1, 3), (None, None)], key=str)
    kept = D.drop_contaminated(awkward_docs(spark, extra=True), benchmark)
    assert kept.count() == 7 and kept.columns == awkward_docs(spark, extra=True).columns
    assert rows(D.contaminated(empty_docs(spark), benchmark)) == []
    assert D.drop_contaminated(awkward_docs(spark), benchmark.limit(0)).count() == 10
