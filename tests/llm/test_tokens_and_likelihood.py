import inspect
import math
import random
import zlib

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs, prose, rows
from tokenizers import Tokenizer

from combirisk.llm import pseudo_likelihood as L
from combirisk.llm import tokens


def test_offsets_agree_with_another_library():
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    coder = tokens.Vocabulary.read(tokens.VOCABULARY)
    draw = random.Random(1)
    for _ in range(50):
        text = prose(draw, 40) + draw.choice(["", " !!!", "\n\n  x", " 123 4567", "<|endoftext|>"])
        ends = [b for _, b in other.encode(text, add_special_tokens=False).offsets]
        assert coder.token_ends(text).tolist() == ends


@pytest.mark.parametrize("rule", tokens.RULES)
def test_allocation_matches_brute_force(rule):
    draw = random.Random(4)
    for _ in range(300):
        total = draw.randrange(1, 40)
        token_ends = np.array(sorted({total, *(draw.randrange(1, total + 1) for _ in range(draw.randrange(12)))}))
        section_ends = np.array(sorted([total, *(draw.randrange(total + 1) for _ in range(draw.randrange(6)))]))
        section_of = [int(np.searchsorted(section_ends, b, side="right")) for b in range(total)]
        want, crossing, start = [0] * len(section_ends), [0] * len(section_ends), 0
        for end in token_ends.tolist():
            held = section_of[start:end]
            pick = held[0] if rule == "start" else max(sorted(set(held)), key=held.count)
            want[pick] += 1
            crossing[pick] += len(set(held)) > 1
            start = end
        got = tokens.allocate(token_ends, section_ends, rule)
        assert got[0].tolist() == want and got[1].tolist() == crossing


def test_attribution_covers_all_tokens(spark):
    docs = awkward_docs(spark, extra=True)
    got = rows(tokens.attribute_tokens(tokens.document_records(docs)))
    assert len(got) == 60
    coder = tokens.Vocabulary.read(tokens.VOCABULARY)
    per = {}
    for doc_id, _, _, n, _ in got:
        per[doc_id] = per.get(doc_id, 0) + n
    row = docs.where("doc_id = 5").first()
    assert per[5] == len(coder.token_ends(f"{row['source']} {row['lang']} {row['text']}"))
    assert rows(tokens.attribute_tokens(tokens.document_records(empty_docs(spark)))) == []


def test_gradients_lower_the_loss_and_probabilities_add_up():
    draw = np.random.default_rng(3)
    network = L.Network.start(np.ones(L.SYMBOLS))
    symbols = np.concatenate([[0, 0], np.tile([5, 70, 900, 3000], 300), [0, 0]])
    at = np.arange(2, 1202)
    every = np.tile(symbols[:5], (L.SYMBOLS, 1))
    every[:, 2] = np.arange(L.SYMBOLS)
    whole = sum(float(np.exp(network.log_probabilities(e, np.array([2])))[0]) for e in every[:: L.SYMBOLS // 64])
    assert 0 < whole < 1
    flat = every.reshape(-1)
    assert abs(np.exp(network.log_probabilities(flat, np.arange(L.SYMBOLS) * 5 + 2)).sum() - 1) < 1e-3
    before = network.log_probabilities(symbols, at).mean()
    trainer = L.Trainer(network)
    for _ in range(20):
        trainer.train(symbols, draw.permutation(at))
    assert trainer.net.log_probabilities(symbols, at).mean() > before + 2


def test_scores_prefer_the_order_that_was_seen(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 2)
    monkeypatch.setattr(L, "BATCH", 64)
    draw = random.Random(6)
    pairs = {w: draw.choice(WORDS) for w in WORDS}

    def chain(n):
        out = [draw.choice(WORDS)]
        while len(out) < n:
            out.append(pairs[out[-1]] if draw.random() < 0.9 else draw.choice(WORDS))
        return out

    texts = [chain(120) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    model = L.fit(docs, rounds=3, parts=4)
    mixed = [(1000 + i, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(texts[:60])]
    fresh = [(i, " ".join(chain(120))) for i in range(60)]
    got = dict(rows(L.score(spark.createDataFrame(fresh + mixed, "doc_id long, text string"), model).select("doc_id", "per_token")))
    assert np.mean([got[i] for i in range(60)]) > np.mean([got[1000 + i] for i in range(60)]) + 0.1


def test_awkward_rows(spark):
    docs = awkward_docs(spark, extra=True)
    model = L.fit(docs)
    got = rows(L.score(docs, model).select("doc_id", "n_tokens", "log_likelihood", "per_token"))
    assert len(got) == 10 and (None, 0, 0.0, None) in got and (3, 0, 0.0, None) in got
    assert rows(L.score(empty_docs(spark), L.fit(empty_docs(spark)))) == []


def test_every_token_is_trained_on_once_whatever_the_batches():
    defaults = {n: p.default for n, p in inspect.signature(L.fit).parameters.items()}
    assert defaults["rounds"] == defaults["parts"]
    ids, counts = np.array([5, -1, 12, 7]), np.array([400, 0, 3, 250])
    whole = L.part_of(ids, counts, defaults["parts"])
    assert set(whole.tolist()) == set(range(defaults["parts"])) and len(whole) == 653
    assert L.part_of(ids[2:], counts[2:], defaults["parts"]).tolist() == whole[400:].tolist()


def test_words_of_one_bucket_have_their_own_probabilities(spark):
    draw = random.Random(9)
    bucket = lambda w: zlib.crc32(w.encode()) % L.BUCKETS
    rare = [f"rare{i}" for i in range(3000)]
    one = next(w for w in rare[1:] if bucket(w) == bucket(rare[0]))
    unseen = next(w for i in range(10_000) if bucket(w := f"new{i}") == bucket(rare[0]))
    counts = {w: 1 for w in rare} | {rare[0]: 5} | {f"often{i}": 9 for i in range(L.FIRST_BUCKET - 1)}
    tokens_ = [w for w, n in counts.items() for _ in range(n)]
    draw.shuffle(tokens_)
    docs = spark.createDataFrame([(i, " ".join(tokens_[i::200])) for i in range(200)], "doc_id long, text string")
    single = [*counts, unseen, *(f"{one} {w}" for w in (rare[0], one))]
    got = dict(rows(L.score(spark.createDataFrame(list(enumerate(single)), "doc_id long, text string"), L.fit(docs)).select("doc_id", "log_likelihood")))
    of = {w: got[i] for i, w in enumerate(single)}
    assert abs(of[rare[0]] - of[one] - math.log(5)) < 1e-6 and abs(of[unseen] - of[one]) < 1e-6
    assert abs(of[f"{one} {rare[0]}"] - of[f"{one} {one}"] - math.log(5)) < 1e-6
    # The counted words have all of the probability but the shares of unseen words.
    assert 0.8 < sum(math.exp(of[w]) for w in counts) < 1


from helpers import WORDS  # noqa: E402
