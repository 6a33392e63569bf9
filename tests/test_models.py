"""Models: planted signal is learnt; label encoding strips nominal metadata."""
from pyspark.sql import functions as F

from bizlens.operators import metrics as mt
from bizlens.operators import models as md
from bizlens.operators import sampling as sp


def test_label_encode_order_and_plain_int(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "a"), (6, "b")], "unique_id long, c string")
    out = {r.unique_id: r.c_index for r in md.label_encode(df, ["c"]).collect()}
    assert out == {1: 0, 3: 0, 6: 0, 2: 1, 5: 1, 4: 2}
    field = md.label_encode(df, ["c"]).schema["c_index"]
    assert field.dataType.simpleString() == "int" and not field.metadata.get("ml_attr")


def test_rf_learns_planted_signal(spark):
    df = spark.range(2000).select(F.col("id").alias("unique_id"), (F.col("id") % 10).cast("int").alias("f1"),
                                  (F.col("id") % 7).cast("int").alias("f2"))
    df = df.withColumn("closed", F.when(F.col("f1") >= 7, 1).otherwise(0))
    feats = md.assemble(df, include=["f1", "f2"])
    train, test = sp.split(feats, ["closed"], 0.2, "unique_id", 1)
    model = md.fit_rf(sp.oversample(train, "closed", "unique_id", 1), trees=10, depth=4)
    scored = md.score(model, test)
    assert mt.roc_auc(scored, "closed", "p_closed").first().auc > 0.95
    imp = md.importance_table(model, ["f1", "f2"], spark).collect()
    assert imp[0].feature == "f1" and abs(sum(r.importance for r in imp) - 1.0) < 1e-9


def test_embedding_export_schema_and_zero_default(spark):
    names = spark.createDataFrame(
        [(1, "raw a", "이디야커피"), (2, "raw b", "cu 편의점"), (3, "raw c", "이디야커피"), (4, "raw d", "한글 abc")],
        "unique_id long, bizname string, clean_name string")
    model = md.train_name_embedding(names.where("unique_id <> 2"), iters=2)
    out = md.export_embeddings(names, model)
    assert out.columns == ["unique_id", "business_name", "cleaned_business_name", "embedding_array"]
    assert out.schema["embedding_array"].dataType.simpleString() == "array<float>"
    vecs = {r.unique_id: r.embedding_array for r in out.collect()}
    assert all(len(v) == 50 for v in vecs.values())
    assert all(x == 0.0 for x in vecs[2])                  # not in the vocabulary
    assert any(x != 0.0 for x in vecs[1]) and vecs[1] == vecs[3]
    assert any(x != 0.0 for x in vecs[4])                  # looked up with the script-joined key
    # whole names as tokens: looked up by the script-joined key, or strictly by the raw one
    whole = md.train_name_embedding(names.where("unique_id <> 2"), iters=2, tokens="whole")
    joined = {r.unique_id: r.embedding_array for r in md.export_embeddings(names, whole, tokens="whole").collect()}
    assert any(x != 0.0 for x in joined[4]) and all(x == 0.0 for x in joined[2])
    strict = {r.unique_id: r.embedding_array for r in md.export_embeddings(names, whole, strict_reference=True, tokens="whole").collect()}
    assert all(x == 0.0 for x in strict[4])                # the reference's key mismatch


def test_factored_embedding_finds_synonyms(spark):
    """Words used in the same places are nearer than any others; names without a known word get zeros."""
    import random

    import numpy as np
    from bizlens.operators import embedding as em
    rnd, rows = random.Random(3), []
    for i in range(1200):
        words = [f"t{i % 4}w{rnd.randrange(10)}" for _ in range(3)]
        if i % 4 < 2:
            words.insert(1, rnd.choice([["syna", "synb"], ["sync", "synd"]][i % 4]))
        rows.append((i, " ".join(words)))
    rows += [(9000, "alone"), (9001, None), (9002, ""), (9003, "t1w1 unheard")] + [(10_000 + k, "t2w1 t2w2") for k in range(600)]
    names = spark.createDataFrame([(i, t, t) for i, t in rows], "unique_id long, bizname string, clean_name string").repartition(5)
    vectors = em.word_vectors(names, dim=16)
    v = {r.word: np.array(r.vector) for r in vectors.collect()}
    near = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    for a, b in (("syna", "synb"), ("sync", "synd")):
        assert near(a, b) > 0.9 and near(a, b) > max(near(a, w) for w in v if w not in (a, b))
    out = em.export_name_vectors(names, vectors, 16)
    got = {r.unique_id: r.embedding_array for r in out.collect()}
    assert out.columns == ["unique_id", "business_name", "cleaned_business_name", "embedding_array"] and out.count() == len(rows)
    assert not any(got[9000]) and not any(got[9001]) and not any(got[9002]) and any(got[9003]) and {len(x) for x in got.values()} == {16}
    assert em.word_vectors(names.limit(0), dim=4).count() == 0


def test_word_pairs_count_both_directions(spark):
    from bizlens.operators import embedding as em
    names = spark.createDataFrame([("a b c",), ("a b c",), ("c",), ("a a",)], "clean_name string")
    got = {(r.a, r.b): r.n for r in em.word_pairs(names, window=1).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 2, ("c", "b"): 2, ("a", "a"): 2}


def test_joined_labels_equal_those_of_the_indexer(spark):
    rows = [(i, v, None if i % 7 == 0 else i % 5) for i, v in enumerate(["b", "a", "a", None, "hot", "", "é", "Z", "b"] + ["hot"] * 40 + [f"c{k}" for k in range(30)])]
    df = spark.createDataFrame(rows, "unique_id int, name string, number int").repartition(5)
    one = md.label_encode(df, ["name", "number"])
    two = md.label_encode_joined(df, ["name", "number"])
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    nulls = md.label_encode_joined(df.where("name IS NULL"), ["name"])
    assert [r["name_index"] for r in nulls.collect()] == [0] and md.label_encode_joined(df.limit(0), ["name"]).count() == 0


def test_equal_rows_train_as_one_with_their_number(spark):
    """Trees on collapsed rows: boosted ones are those of the single rows, a forest's votes differ by its draws only."""
    df = spark.range(3000).select(F.col("id").alias("unique_id"), (F.col("id") % 4).cast("int").alias("a"), (F.col("id") % 3).cast("int").alias("b"))
    df = df.withColumn("closed", F.when((F.col("a") == 1) | ((F.col("b") == 2) & (F.col("unique_id") % 5 < 2)), 1).otherwise(0))
    by = ["a", "b", "closed"]
    groups = md.collapsed(df, by)
    assert groups.agg(F.sum("weight")).first()[0] == 3000 and groups.count() == df.select(*by).distinct().count() == 15
    on = lambda rows: md.assemble(md.one_hot(rows, ["a", "b"]), include=["a_vec", "b_vec"])
    few, all_rows = on(groups), on(df)

    def votes(model):
        return {(r.a, r.b): r.p_closed for r in md.score(model, few, keep=["a", "b"]).collect()}

    one, two = votes(md.fit_gbt(few, weight_col="weight", rounds=4, depth=3)), votes(md.fit_gbt(all_rows, rounds=4, depth=3))
    assert len(one) == 12 and all(abs(one[k] - two[k]) < 1e-9 for k in two)
    forest = md.fit_rf_collapsed(few, by, trees=20, depth=6)
    one, two = votes(forest), votes(md.fit_rf(all_rows, trees=20, depth=6))
    assert all(abs(one[k] - two[k]) < 0.15 for k in two) and one == votes(forest)
    got = {(r.a, r.b): r.prediction for r in md.score(forest, few, keep=["a", "b"]).collect()}
    assert all(p == (a == 1) for (a, b), p in got.items())
    assert votes(md.fit_rf_collapsed(few, by, trees=20, depth=6)) == one


def test_embedding_tasks_follow_the_names(spark, monkeypatch):
    asked, real = [], md.Word2Vec
    monkeypatch.setattr(md, "Word2Vec", lambda **kw: asked.append(kw["numPartitions"]) or real(**kw))
    monkeypatch.setattr(md, "W2V_ROWS", 4)
    for n in (32, 50):
        md.train_name_embedding(spark.range(n).select(F.concat(F.lit("a b"), F.col("id")).alias("clean_name")), iters=1, dim=2)
    assert asked == [8, 13]
