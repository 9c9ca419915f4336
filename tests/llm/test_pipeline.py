import os
import random

import corpus_pipeline
from helpers import CLASHING, prose

from combirisk.llm.catalog import CHECKS, QUERIES


def planted(spark, folder):
    draw = random.Random(21)
    items = [f"{prose(draw, 40)}. {prose(draw, 8)}." for _ in range(3)]
    passage = prose(draw, 70)
    data, labels = [], []
    for i in range(260):
        words = prose(draw, draw.randrange(60, 160)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                words.insert(draw.randrange(len(words)), draw.choice(["grumblex", "snarfly"]))
        text = " ".join(words)
        if i in (201, 202):
            text += " " + items[i - 201] + " " + prose(draw, 20)
        if i in (211, 212, 213):
            text += " " + passage
        data.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(toxic)))
    for i, of in ((300, 101), (301, 101), (302, 102)):
        # 302 is a near copy: its last word differs.
        data.append([i, data[of][1] if i != 302 else data[of][1].rsplit(" ", 1)[0] + " replaced", "en", "s0", 1])
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return passage


def test_decisions_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    passage = planted(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}.parquet")
        docs = spark.read.parquet(f"{folder}/stage{k}.parquet")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(260) if i % 5} | {300, 301, 302}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {300, 301, 302}
    assert set(kept[2]) == set(kept[1])
    for i in (211, 212, 213):
        assert passage not in kept[2][i]["text"] and len(kept[2][i]["text"]) == kept[2][i]["n_chars"]
    assert all(kept[2][i]["text"] == kept[1][i]["text"] for i in kept[2] if i not in (211, 212, 213))
    assert set(kept[3]) == set(kept[2]) - {201, 202}
    assert set(kept[4]) <= set(kept[3]) and kept[4]
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == docs.count()


def test_empty_and_extra_columns(spark, tmp_path):
    folder = str(tmp_path)
    planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for column in CLASHING.split(", "):
        name, kind = column.split(" ")
        docs = docs.selectExpr("*", f"cast(null as {kind}) as `{name}`")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), folder).collect() == []
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), folder).collect() == []


def test_every_operator_is_registered():
    names = sorted(QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(CHECKS) <= set(QUERIES)
    assert os.path.exists(corpus_pipeline.__file__)
