"""The pipeline, stage by stage, against plain Python on the smallest tables."""

import os
import random
import shutil

import corpus_pipeline
import pytest
from bizlens.llm.decontamination import normal
from bizlens.llm.toxicity import Scorer, train
from llm_cases import make_docs, vocabulary_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with a planted case for every stage."""
    rnd, vocab = random.Random(31), vocabulary_words(n=300)
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        t = text(rnd.randint(30, 90))
        if k % 6 == 0:
            w = t.split()
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["fooey", "blast", "cursed"]))
            t = " ".join(w)
        rows.append((k, t, f"site{k % 12}"))
        labels.append((k, 1, int(k % 6 == 0)))
    base, item, line = text(100), text(25), "All rights reserved by nobody at all."
    rows += [(1000, base, "site1"), (1001, base, "site2"), (1002, base + " tail", "site3"), (1003, text(40) + " " + item + " " + text(40), "site4")]
    rows += [(1010 + k, text(40) + "\n" + line, f"site{k}") for k in range(12)]
    rows += [(1100, None, "site1"), (1101, "", None)]
    d = tmp_path_factory.mktemp("tables")
    make_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    yield str(d), rows, item, line
    shutil.rmtree(d, ignore_errors=True)


def test_stages(spark, folder):
    d, rows, item, line = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, texts = docs.columns, {i: t for i, t, _ in rows}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = os.path.join(d, f"out-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    scorer = Scorer(train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")))
    kept = {i for i, t in texts.items() if scorer.score(*scorer.document(t or "")) < 0.5}
    assert set(seen["toxicity"]) == kept and {1000, 1003, 1100, 1101} <= kept and len(kept & set(range(0, 400, 6))) < 4
    assert set(seen["line_dedup"]) == kept
    for i in range(1010, 1022):
        assert line not in seen["line_dedup"][i]["text"] and seen["line_dedup"][i]["n_chars"] == len(seen["line_dedup"][i]["text"])
    assert {1001, 1002} & set(seen["near_dup"]) == set() and set(seen["near_dup"]) == kept - {1001, 1002}
    assert set(seen["decontamination"]) == set(seen["near_dup"]) - {1003}
    assert all(normal(item) not in normal(r["text"]) for r in seen["decontamination"].values())
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(seen["packing"])
