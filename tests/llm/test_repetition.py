import random
from collections import Counter

from helpers import awkward_docs, empty_docs, rows

from combirisk.llm.repetition import repetition_rules, word_repeats


def plain(words, least):
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    near = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            h = 0
            while i != j and max(i, j) + h < n and words[i + h] == words[j + h]:
                h += 1
            longest[i] = max(longest[i], h)
    spans = {j for i in range(n) if longest[i] >= least for j in range(i, i + longest[i])}
    top = max(longest, default=0)
    return len(near), len(spans), top if top >= 3 else 0


def test_repeats_match_brute_force():
    draw = random.Random(1)
    for _ in range(120):
        texts = [[b"%d" % draw.randrange(draw.choice([1, 2, 4, 30])) for _ in range(draw.randrange(40))] for _ in range(draw.randrange(1, 6))]
        got = word_repeats(texts, 4)
        assert [tuple(int(g[k]) for g in got) for k in range(len(texts))] == [plain(t, 4) for t in texts]


def test_counts(spark):
    text = "a b c\n\n# x & y\na b c\n" + "é\x0bé " * 30
    got = repetition_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = [w for w in text.replace("\x0b", " ").split(" ") for w in w.split("\n") if w]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == 2 and got["n_dup_lines"] == 1
    assert got["base_failed"] and not got["kept"]


def test_awkward_rows(spark):
    got = rows(repetition_rules(awkward_docs(spark, extra=True)).select("doc_id", "n_words", "base_failed", "kept"))
    assert len(got) == 10 and (None, 0, True, False) in got and (5, 30000, False, True) in got
    assert rows(repetition_rules(empty_docs(spark))) == []
