"""Registered queries: encoding, models, embeddings, spatial, streaming and
bulk enrichment.  Model training and streaming have no SQL oracle (the driver
records a rows-only check); encodings, spatial joins, the coordinate
transform and bulk enrichment do."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hashing import duck_hash
from ..operators import address as ad
from ..operators import embedding as em
from ..operators import features as feat
from ..operators import filters as flt
from ..operators import joins as jn
from ..operators import models as md
from ..operators import paging as pg
from ..operators import sampling as sp
from ..operators import spatial as spt
from ..session import scratch_path
from ..sources.licences import address_responses, licences
from ..sources.tables import read_source
from ..streaming import ingest
from . import duck
from .catalog import FRANCHISE_MIN, SAMPLE_TARGET, WINDOW_YEAR, _names, register, with_lic
from .catalog_more import AS_OF, DUCK_PARSED, DUCK_REQ, SAMPLE_SEED, SPLIT_SEED, _duck_bronze, _requests

CAT_COLS = ["sido", "sigungu", "dong", "operating_bucket", "service", "subtype"]
FEATURES = [f"{c}_index" for c in CAT_COLS]


# ----------------------------------------------------------------- encoding --
def _with_bucket(lic: DataFrame) -> DataFrame:
    d = feat.operating_days("license_date", "closure_date", AS_OF)
    return lic.withColumn("operating_bucket", feat.period_bucket(d))


def _duck_index(col: str, src: str = "lb") -> str:
    return (f"CAST((SELECT r FROM (SELECT v, row_number() OVER (ORDER BY c DESC, v ASC) - 1 AS r FROM "
            f"(SELECT {col} AS v, count(*) AS c FROM {src} GROUP BY {col}) g) x WHERE x.v = {src}.{col}) AS INTEGER)")


DUCK_LB = f"""
, lb AS (SELECT *, CASE WHEN d < 365 THEN '<1y' WHEN d < 1095 THEN '1-3y' WHEN d < 1825 THEN '3-5y'
                        WHEN d < 3650 THEN '5-10y' WHEN d IS NOT NULL THEN '10y+' END AS operating_bucket
         FROM (SELECT *, date_diff('day', license_date, coalesce(closure_date, DATE '{AS_OF}')) AS d FROM lic) t)
"""


_INDEXED = with_lic(DUCK_LB + f"""
SELECT unique_id, {', '.join(f'{_duck_index(c)} AS {c}_index' for c in CAT_COLS)} FROM lb""")


@register("label_encode", _INDEXED)
def label_encode(spark, sf):
    """Ordinal encoding of the six categorical features."""
    lic = _with_bucket(licences(spark, sf))
    return md.label_encode(lic, CAT_COLS).select("unique_id", *FEATURES)


@register("label_encode_joined", _INDEXED)
def label_encode_joined(spark, sf):
    """E1 by ranked category tables, for columns of any number of categories."""
    return md.label_encode_joined(_with_bucket(licences(spark, sf)), CAT_COLS).select("unique_id", *FEATURES)


SEGMENTS = 5


@register("one_hot", with_lic(DUCK_LB + f"""
, e AS (SELECT unique_id, {_duck_index('service')} AS service_index FROM lb)
SELECT unique_id, service_index, {', '.join(f'CAST(CASE WHEN service_index = {i} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS service_oh_{i}'
                                            for i in range(SEGMENTS))} FROM e"""))
def one_hot(spark, sf):
    """One-hot vector of the industry index (flattened for comparison)."""
    from pyspark.ml.functions import vector_to_array
    enc = md.label_encode(licences(spark, sf).select("unique_id", "service"), ["service"])
    oh = md.one_hot(enc, ["service_index"])
    arr = vector_to_array("service_index_vec")
    # the encoder adds one slot for unseen values; more segments than columns must not vanish
    arr = F.when(F.size(arr) > SEGMENTS + 1, F.raise_error(F.lit("more segments than one-hot columns"))).otherwise(arr)
    return oh.select("unique_id", "service_index", *[F.get(arr, i).alias(f"service_oh_{i}") for i in range(SEGMENTS)])


# ------------------------------------------------------------------- models --
def _model_features(spark, sf) -> DataFrame:
    lic = flt.in_window(_with_bucket(licences(spark, sf)), "closure_date", WINDOW_YEAR)
    enc = md.label_encode(lic, CAT_COLS)
    return md.assemble(enc, include=FEATURES).select("unique_id", "service", "closed", "features")


@register("assemble_features", with_lic(DUCK_LB + f"""
, lbw AS (SELECT * FROM lb WHERE closure_date >= DATE '{WINDOW_YEAR}-01-01' OR closure_date IS NULL)
SELECT unique_id, closed, {', '.join(f'CAST({_duck_index(c, "lbw")} AS DOUBLE) AS feature_{i}'
                                     for i, c in enumerate(CAT_COLS))} FROM lbw"""))
def assemble_features(spark, sf):
    """E5 (+F1, C14, E1): the model feature vector, flattened for comparison."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return _model_features(spark, sf).select(
        "unique_id", "closed", *[F.get(arr, i).alias(f"feature_{i}") for i in range(len(FEATURES))])


def _train_test(spark, sf):
    # the split table feeds sampling, oversampling, fitting and scoring: it is
    # written once to the checkpoint folder (lineage cut)
    feats = _model_features(spark, sf)
    train, test = sp.split(feats, ["service", "closed"], 0.1, "unique_id", SPLIT_SEED, materialize=True)
    sample = sp.sample_to(train, ["closed"], SAMPLE_TARGET, "unique_id", SAMPLE_SEED).where("sampled").drop("sampled")
    return md.training_input(sample), test


@register("rf_score")
def rf_score(spark, sf):
    """E9a + E11 + E14: oversampled random forest scored on the hold-out set."""
    sample, test = _train_test(spark, sf)
    over = sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED, keep_originals=False)
    model = md.fit_rf(md.training_input(over))
    return md.score(model, test)


@register("gbt_score")
def gbt_score(spark, sf):
    """E9b + E12 + E14: oversampled boosted trees scored on the hold-out set."""
    sample, test = _train_test(spark, sf)
    over = sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED, keep_originals=True)
    model = md.fit_gbt(md.training_input(over))
    return md.score(model, test)


@register("importance")
def importance(spark, sf):
    """Top-20 feature importances of the oversampled random forest."""
    sample, _ = _train_test(spark, sf)
    over = sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED)
    return md.importance_table(md.fit_rf(md.training_input(over)), FEATURES, spark, 20)


def _strategies(sample: DataFrame, test: DataFrame, trees: int = md.RF_TREES, **grid) -> DataFrame:
    """(strategy, metric, value) of four treatments of the rare class on one sample and one hold-out set."""
    sample = md.training_input(sample)
    runs = {
        "class_weights": (sp.with_class_weights(sample, "closed"), "weight"),
        "undersample": (sp.undersample(sample, "closed", "unique_id", SAMPLE_SEED).where("kept").drop("kept"), None),
        "oversample": (sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED), None),
    }
    models = md.fit_concurrently({
        name: (lambda t=train, w=wcol: md.fit_rf(md.training_input(t), weight_col=w, trees=trees))
        for name, (train, wcol) in runs.items()})
    folded = sample.withColumn("fold", md.fold_column("unique_id"))
    models["tuned"] = md.grid_search(md.training_input(sp.oversample(folded, "closed", "unique_id", SAMPLE_SEED)), trees=trees, **grid).bestModel
    return pg.union_all(*[md.evaluate(md.score(model, test)).select(F.lit(name).alias("strategy"), "metric", "value") for name, model in models.items()])


@register("experiment_table")
def experiment_table(spark, sf):
    """E10 + E8 + E9 + E13 + E15: four class-imbalance strategies compared on the
    hold-out set: class weights, undersampling, oversampling, and oversampling
    with the parameters tuned by cross-validation."""
    return _strategies(*_train_test(spark, sf))


@register("grid_search")
def grid_search(spark, sf):
    """3-fold grid search (depth x min leaf) on oversampled data, folds
    fixed by licence id before oversampling; reports the best model's metrics."""
    sample, test = _train_test(spark, sf)
    folded = sample.withColumn("fold", md.fold_column("unique_id"))
    over = sp.oversample(folded, "closed", "unique_id", SAMPLE_SEED)
    cv = md.grid_search(md.training_input(over))
    best = cv.bestModel
    params = F.lit(f"maxDepth={best.getMaxDepth()},minInstancesPerNode={best.getMinInstancesPerNode()}")
    return md.evaluate(md.score(best, test)).select(params.alias("best_params"), "metric", "value")


def _feature_sets(variants: dict[str, DataFrame], strata=("service", "closed"), rounds: int = md.GBT_ROUNDS) -> DataFrame:
    """(feature_set, metric, value): boosted trees on each variant of the features, same split and sample."""

    def run(df):
        sample, test = sp.split_and_sample(df, list(strata), 0.1, ["closed"], SAMPLE_TARGET, "unique_id", SPLIT_SEED, SAMPLE_SEED)
        over = sp.oversample(md.training_input(sample), "closed", "unique_id", SAMPLE_SEED, keep_originals=True)
        return md.fit_gbt(md.training_input(over), rounds=rounds), test

    fitted = md.fit_concurrently({name: (lambda d=df: run(d)) for name, df in variants.items()})
    return pg.union_all(*[md.evaluate(md.score(model, test)).select(F.lit(name).alias("feature_set"), "metric", "value")
                          for name, (model, test) in fitted.items()])


@register("feature_experiment")
def feature_experiment(spark, sf):
    """E16 (+A3/J1, J2, C16): base features vs +franchise flag vs +name embedding, boosted trees."""
    base = _model_features(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    names = _names(spark, sf)
    flag = feat.franchise_flag(names, FRANCHISE_MIN)
    w2v = md.train_name_embedding(names)
    emb = md.export_embeddings(names, w2v)
    flat = feat.flatten_array(emb, "embedding_array", "embedding_", md.W2V_DIM, keep=["unique_id"])
    from pyspark.ml.feature import VectorAssembler
    variants = {
        "base": base,
        "franchise": VectorAssembler(inputCols=["features", "is_franchise"], outputCol="f2").transform(
            jn.left_join_default(base, flag, "unique_id", {"is_franchise": 0})).drop("features")
        .withColumnRenamed("f2", "features"),
        "embedding": VectorAssembler(inputCols=["features"] + [f"embedding_{i}" for i in range(md.W2V_DIM)],
                                     outputCol="f2").transform(
            jn.left_join_prefix(base, flat, "unique_id", "embedding_", 0.0)).drop("features")
        .withColumnRenamed("f2", "features"),
    }
    return _feature_sets(variants)


@register("embedding_export")
def embedding_export(spark, sf):
    """E3 + E4 + J6: skip-gram name embeddings exported per licence."""
    from pyspark.ml.feature import Word2VecModel
    names = _names(spark, sf)
    path = scratch_path(spark, f"name-embedding-{uuid.uuid4().hex}")
    md.save_model(md.train_name_embedding(names), path)
    return md.export_embeddings(names, md.load_model(Word2VecModel, path))


def _written_names(spark, sf, write) -> DataFrame:
    path = scratch_path(spark, f"names-{uuid.uuid4().hex}")
    write(licences(spark, sf).select("unique_id", "bizname", "service"), path)
    return spark.read.parquet(path)


@register("append_table", with_lic("SELECT unique_id, bizname, service FROM lic"))
def append_table(spark, sf):
    """The register written as two appends, read back."""
    def write(lic, path):
        from ..sources.tables import write_table
        write_table(lic.where("unique_id % 2 = 0"), path, mode="append")
        write_table(lic.where("unique_id % 2 <> 0"), path, mode="append")
    return _written_names(spark, sf, write)


@register("rebuild_table", with_lic("SELECT unique_id, bizname, service FROM lic WHERE closed = 1"))
def rebuild_table(spark, sf):
    """A table of all licences rebuilt with the closed ones; a rebuild that fails half way then changes nothing."""
    from ..sources.tables import read_table, rebuild_table as rebuild
    path = scratch_path(spark, f"rebuilt-{uuid.uuid4().hex}")
    rows = licences(spark, sf).select("unique_id", "bizname", "service")
    rebuild(rows, path)
    rebuild(licences(spark, sf).where("closed = 1").select(*rows.columns), path)
    broken = F.when(F.col("unique_id") % 3 == 0, F.raise_error(F.lit("half way"))).otherwise(F.col("service")).alias("service")
    try:
        rebuild(rows.select("unique_id", "bizname", broken), path)
    except Exception as exc:
        if "half way" not in str(exc):
            raise
    return read_table(spark, path)


@register("published_fan_out", with_lic("""
SELECT unique_id, service, 'silver' AS sink FROM lic WHERE closed = 1
UNION ALL SELECT unique_id, service, 'bronze' AS sink FROM lic WHERE closed = 1"""))
def published_fan_out(spark, sf):
    """Two sinks published as one version, twice; both show the second."""
    from ..sources.tables import fan_out_together, read_table
    root = scratch_path(spark, f"fan-out-{uuid.uuid4().hex}")
    rows = licences(spark, sf)
    for part in (rows, rows.where("closed = 1")):
        fan_out_together(part, root, {"bronze": None, "silver": ["unique_id", "service"]})
    silver, bronze = (read_table(spark, root, name=n) for n in ("silver", "bronze"))
    return silver.withColumn("sink", F.lit("silver")).unionByName(bronze.select("unique_id", "service", F.lit("bronze").alias("sink")))


@register("embedding_coverage", with_lic(f"""
SELECT l.unique_id, CAST({md.W2V_DIM} AS INTEGER) AS dims, n.clean_name IS NOT NULL AND n.clean_name <> '' AS has_vector
FROM n3 n JOIN lic l ON l.unique_id = n.unique_id""", names=True))
def embedding_coverage(spark, sf):
    """E3 + E4: every exported name has a vector of the full length, not all zeros."""
    out = embedding_export(spark, sf)
    return out.select("unique_id", F.size("embedding_array").alias("dims"), F.exists("embedding_array", lambda v: v != 0).alias("has_vector"))


@register("embedding_factored", with_lic(f"""
, tok AS (SELECT unique_id, list_filter(string_split({duck.collapse(duck.script_boundary('clean_name'))}, ' '), lambda w: w <> '') AS ws FROM n3),
near AS (SELECT list(DISTINCT word) AS words FROM (SELECT unnest(ws) AS word FROM tok WHERE len(ws) > 1) t)
SELECT unique_id, CAST({md.W2V_DIM} AS INTEGER) AS dims, coalesce(list_has_any(ws, (SELECT words FROM near)), false) AS has_vector FROM tok""", names=True))
def embedding_factored(spark, sf):
    """E3 + E4 + J6 without a driver vocabulary: names of words with neighbours get a vector, all others zeros."""
    names = _names(spark, sf)
    out = em.export_name_vectors(names, em.word_vectors(names))
    return out.select("unique_id", F.size("embedding_array").alias("dims"), F.exists("embedding_array", lambda v: v != 0).alias("has_vector"))


# Fixed rule of the planted label: three of the five industries close.
PLANTED = "CASE WHEN service IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 1 ELSE 0 END"


def _planted(spark, sf):
    """Training and hold-out licences whose label the industry decides."""
    lic = licences(spark, sf).select("unique_id", "service").withColumn("closed", F.expr(PLANTED))
    enc = md.assemble(md.label_encode(lic, ["service"]), include=["service_index"]).select("unique_id", "closed", "features")
    train, test = sp.split(enc, ["closed"], 0.1, "unique_id", SPLIT_SEED, materialize=True)
    sample = sp.sample_to(train, ["closed"], SAMPLE_TARGET, "unique_id", SAMPLE_SEED).where("sampled").drop("sampled")
    return md.training_input(sample), test


DUCK_HOLDOUT = f"""
, pl AS (SELECT unique_id, {PLANTED} AS closed FROM lic),
held AS (SELECT unique_id, closed FROM (SELECT *, row_number() OVER (PARTITION BY closed ORDER BY {duck_hash('unique_id', SPLIT_SEED)}, unique_id)
  <= round(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY closed)) AS t FROM pl) x WHERE t)
"""
_PLANTED_ROWS = with_lic(DUCK_HOLDOUT + "SELECT unique_id, closed, closed AS prediction FROM held")


@register("rf_planted", _PLANTED_ROWS)
def rf_planted(spark, sf):
    """E9a + E11 + E14 where the answer is known: the forest finds the planted rule on every hold-out row."""
    sample, test = _planted(spark, sf)
    over = sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED)
    return md.score(md.fit_rf(md.training_input(over), trees=20), test).select("unique_id", "closed", "prediction")


@register("gbt_planted", _PLANTED_ROWS)
def gbt_planted(spark, sf):
    """E9b + E12 + E14 where the answer is known."""
    sample, test = _planted(spark, sf)
    over = sp.oversample(sample, "closed", "unique_id", SAMPLE_SEED, keep_originals=True)
    return md.score(md.fit_gbt(md.training_input(over), rounds=5), test).select("unique_id", "closed", "prediction")


@register("grid_planted", with_lic(DUCK_HOLDOUT + """
SELECT metric, CAST(1.0 AS DOUBLE) AS value FROM (SELECT unnest(['auc', 'accuracy', 'precision_1', 'recall_1', 'f1_1']) AS metric) m
WHERE (SELECT count(*) FROM held) > 0"""))
def grid_planted(spark, sf):
    """E13 + A6 + A8 where the answer is known: the best model of the grid scores 1 everywhere."""
    sample, test = _planted(spark, sf)
    folded = sample.withColumn("fold", md.fold_column("unique_id"))
    cv = md.grid_search(md.training_input(sp.oversample(folded, "closed", "unique_id", SAMPLE_SEED)), depths=(3, 5), min_leaf=(1,), trees=10)
    return md.evaluate(md.score(cv.bestModel, test))


_METRICS = "(SELECT unnest(['auc', 'accuracy', 'precision_1', 'recall_1', 'f1_1']) AS metric)"


@register("experiment_planted", with_lic(DUCK_HOLDOUT + f"""
SELECT strategy, metric, CAST(1.0 AS DOUBLE) AS value
FROM (SELECT unnest(['class_weights', 'undersample', 'oversample', 'tuned']) AS strategy) s, {_METRICS} m WHERE (SELECT count(*) FROM held) > 0"""))
def experiment_planted(spark, sf):
    """E15 where the answer is known: every treatment of the rare class finds the planted rule."""
    return _strategies(*_planted(spark, sf), trees=10, depths=(3,), min_leaf=(1,))


@register("feature_planted", with_lic(f"""
, flag AS (SELECT l.unique_id, coalesce(f.is_franchise, 0) AS closed FROM lic l LEFT JOIN (
    SELECT n3.unique_id, 1 AS is_franchise FROM n3 JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {FRANCHISE_MIN}) f
    ON n3.clean_name = f.clean_name) f ON l.unique_id = f.unique_id),
two AS (SELECT count(DISTINCT closed) > 1 AS has_both FROM flag)
SELECT feature_set, metric, feature_set = 'franchise' AS perfect FROM (SELECT unnest(['base', 'franchise']) AS feature_set) s, {_METRICS} m
WHERE (SELECT has_both FROM two)""", names=True))
def feature_planted(spark, sf):
    """E16 where the answer is known: the label is the franchise flag, so the features with the flag are right on every row and those without it are not."""
    from pyspark.ml.feature import VectorAssembler
    flag = feat.franchise_flag(_names(spark, sf), FRANCHISE_MIN)
    rows = jn.left_join_default(licences(spark, sf).select("unique_id", "service"), flag, "unique_id", {"is_franchise": 0})
    rows = md.label_encode(rows.withColumn("closed", F.col("is_franchise")), ["service"]).persist(StorageLevel.MEMORY_AND_DISK)
    if rows.select("closed").distinct().count() < 2:
        return spark.createDataFrame([], "feature_set string, metric string, perfect boolean")
    variants = {name: VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
                for name, cols in (("base", ["service_index"]), ("franchise", ["service_index", "is_franchise"]))}
    return _feature_sets(variants, ["closed"], rounds=3).select("feature_set", "metric", (F.col("value") == 1.0).alias("perfect"))


def _compare_models(rows: DataFrame, index_cols: list[str], trees: int = md.RF_TREES, rounds: int = md.GBT_ROUNDS) -> DataFrame:
    """(model, metric, value): forest and boosted trees on the same 80:20 split of one-hot features, all training rows kept.

    Equal rows are fitted and scored as one with their number as its weight; every hold-out row then takes the score of its group.
    """
    by, vecs = [*index_cols, "closed"], [f"{c}_vec" for c in index_cols]
    rows = rows.select(*dict.fromkeys(["unique_id", "service", *by]))
    train, test = sp.split(rows, ["service", "closed"], 0.2, "unique_id", SPLIT_SEED, materialize=True)
    sides = md.collapsed(train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))), ["is_test", *by])
    feats = md.assemble(md.one_hot(sides, index_cols), include=vecs).select("is_test", *by, "weight", "features")
    fit_on, score_on = md.training_input(feats.where("NOT is_test"), by, feats.rdd.getNumPartitions()), feats.where("is_test")
    fitted = md.fit_concurrently({"forest": lambda: md.fit_rf_collapsed(fit_on, by, trees=trees),
                                  "boosted": lambda: md.fit_gbt(fit_on, weight_col="weight", rounds=rounds)})
    match = [test[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    scored = {name: md.score(model, score_on, keep=by).withColumnsRenamed({c: f"_{c}" for c in by}) for name, model in fitted.items()}
    return pg.union_all(*[md.evaluate(test.join(s, match)).select(F.lit(name).alias("model"), "metric", "value") for name, s in scored.items()])


@register("model_comparison")
def model_comparison(spark, sf):
    """E2 + E6 + E11 + E12 + E14: forest against boosted trees on one-hot region, industry and operating period, 80:20, all training rows."""
    lic = flt.in_window(_with_bucket(licences(spark, sf)), "closure_date", WINDOW_YEAR)
    cols = ["sido", "sigungu", "service", "operating_bucket"]
    return _compare_models(md.label_encode(lic, cols), [f"{c}_index" for c in cols])


@register("comparison_planted", with_lic(f"""
SELECT model, metric, CAST(1.0 AS DOUBLE) AS value FROM (SELECT unnest(['forest', 'boosted']) AS model) s, {_METRICS} m
WHERE (SELECT count(DISTINCT {PLANTED}) FROM lic) = 2"""))
def comparison_planted(spark, sf):
    """The same comparison where the answer is known: both models find the planted rule on every hold-out row."""
    rows = licences(spark, sf).select("unique_id", "service").withColumn("closed", F.expr(PLANTED))
    return _compare_models(md.label_encode(rows, ["service"]), ["service_index"], trees=20, rounds=5)


@register("importance_planted", with_lic("SELECT 'service_index' AS feature, CAST(1.0 AS DOUBLE) AS importance WHERE (SELECT count(*) FROM lic) > 0"))
def importance_planted(spark, sf):
    """A12 where the answer is known: the one feature carries all the importance."""
    sample, _ = _planted(spark, sf)
    return md.importance_table(md.fit_rf(md.training_input(sample), trees=10), ["service_index"], spark, 20)


# ------------------------------------------------------------------ spatial --
DUCK_POLY = """
, poly AS (SELECT CAST(n_nationkey AS BIGINT) AS poly_id, r_name AS sido, n_name AS sigungu, n_name || '-poly' AS dong,
     [{'x': CAST(190000.0 + 800.0 * n_nationkey AS DOUBLE), 'y': CAST(439000.0 AS DOUBLE)},
      {'x': CAST(190000.0 + 800.0 * n_nationkey + 800.0 AS DOUBLE), 'y': CAST(439000.0 + 300.0 * (n_nationkey % 3) AS DOUBLE)},
      {'x': CAST(190000.0 + 800.0 * n_nationkey + 800.0 AS DOUBLE), 'y': CAST(461000.0 AS DOUBLE)},
      {'x': CAST(190000.0 + 800.0 * n_nationkey AS DOUBLE), 'y': CAST(458000.0 + 500.0 * (n_nationkey % 4) AS DOUBLE)}] AS ring
   FROM nation JOIN region ON n_regionkey = r_regionkey),
pidx AS (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM poly),
edges AS (SELECT poly_id, sido, sigungu, dong, ring[i].x AS x1, ring[i].y AS y1,
                 ring[(i % len(ring)) + 1].x AS x2, ring[(i % len(ring)) + 1].y AS y2 FROM pidx),
pts AS (SELECT unique_id, x_5174 AS px, y_5174 AS py FROM lic WHERE x_5174 IS NOT NULL AND y_5174 IS NOT NULL),
pip AS (SELECT p.unique_id, e.poly_id, e.sido, e.sigungu, e.dong FROM pts p JOIN edges e
        ON ((e.y1 > p.py) <> (e.y2 > p.py)) AND p.px < (e.x2 - e.x1) * (p.py - e.y1) / (e.y2 - e.y1) + e.x1
        GROUP BY p.unique_id, e.poly_id, e.sido, e.sigungu, e.dong HAVING count(*) % 2 = 1)
"""


def _spatial(spark, sf):
    polys = spt.polygons_from_nations(read_source(spark, sf, "nation"), read_source(spark, sf, "region"))
    return spt.assign_region(licences(spark, sf), polys, "x_5174", "y_5174", cell=1000.0)


@register("point_in_polygon", with_lic(DUCK_POLY + "SELECT * FROM pip"))
def point_in_polygon(spark, sf):
    """Licence coordinates -> (sido, sigungu, dong) by point-in-polygon."""
    return _spatial(spark, sf)


def _duck_ring(corners) -> str:
    return "[" + ", ".join(f"{{'x': CAST(190000.0 + 800.0 * n_nationkey + {dx}.0 AS DOUBLE), 'y': CAST({dy}.0 AS DOUBLE)}}" for dx, dy in corners) + "]"


_ARROW = _duck_ring([(0, 440000), (790, 441100), (400, 450000), (790, 458900), (0, 459900)])
_HOLE = _duck_ring([(50, 446050), (350, 446050), (350, 453950), (50, 453950)])
_ISLAND = _duck_ring([(150, 448000), (250, 450000), (150, 452000)])


@register("point_in_holed_polygon", with_lic(f"""
, parts AS (SELECT CAST(n_nationkey AS BIGINT) AS poly_id, n_name AS sigungu, {_ARROW} AS ring FROM nation
            UNION ALL SELECT n_nationkey, n_name, {_HOLE} FROM nation WHERE n_nationkey % 2 = 0
            UNION ALL SELECT n_nationkey, n_name, {_ISLAND} FROM nation WHERE n_nationkey % 2 = 0),
corner AS (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM parts),
side AS (SELECT poly_id, sigungu, ring[i].x AS x1, ring[i].y AS y1, ring[(i % len(ring)) + 1].x AS x2, ring[(i % len(ring)) + 1].y AS y2 FROM corner)
SELECT unique_id, poly_id, side.sigungu FROM lic JOIN side ON ((y1 > y_5174) <> (y2 > y_5174)) AND x_5174 < (x2 - x1) * (y_5174 - y1) / (y2 - y1) + x1
GROUP BY unique_id, poly_id, side.sigungu HAVING count(*) % 2 = 1"""))
def point_in_holed_polygon(spark, sf):
    """J8 on concave polygons with holes and islands in them, cells smaller than the polygons."""
    return spt.assign_region(licences(spark, sf), spt.holed_from_nations(read_source(spark, sf, "nation")), "x_5174", "y_5174", cell=130.0, attrs=("sigungu",))


@register("region_fallback", with_lic(DUCK_POLY + DUCK_PARSED + """
SELECT lic.unique_id, coalesce(s.sido, p.siNm) AS sido, CASE WHEN s.sido IS NULL THEN p.sggNm ELSE s.sigungu END AS sigungu,
       CASE WHEN s.sido IS NULL THEN p.emdNm ELSE s.dong END AS dong,
       CASE WHEN s.sido IS NOT NULL THEN 'spatial' WHEN p.siNm IS NOT NULL THEN 'lookup' END AS region_source
FROM lic LEFT JOIN pip s ON s.unique_id = lic.unique_id
LEFT JOIN parsed p ON p.uid = lic.unique_id AND s.unique_id IS NULL AND trim(coalesce(lic.road_address, '')) <> ''"""))
def region_fallback(spark, sf):
    """One row per licence: spatial region where coordinates resolve, else the
    address-lookup region (licences without coordinates or outside every polygon)."""
    lic = licences(spark, sf)
    spatial = _spatial(spark, sf)
    open_rows = lic.where(F.trim("road_address") != "").join(spatial.select("unique_id"), "unique_id", "left_anti")
    requests = open_rows.select(F.col("unique_id").alias("uid"), F.col("unique_id").alias("id"), F.col("road_address").alias("full_address"))
    lookup = ad.resolve_address(requests, address_responses(spark, sf)).select(
        F.col("uid").cast("bigint").alias("unique_id"), F.col("siNm").alias("sido"),
        F.col("sggNm").alias("sigungu"), F.col("emdNm").alias("dong"))
    return jn.merge_region(lic, spatial, lookup, "unique_id")


@register("plane_to_geographic", with_lic(f"""
SELECT unique_id, x_5174, y_5174, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (
{geo.duck_plane_to_geographic("(SELECT unique_id, x_5174, y_5174 FROM lic WHERE x_5174 IS NOT NULL)", "x_5174", "y_5174")}
) g"""))
def plane_to_geographic(spark, sf):
    """EPSG:5174 plane coordinates -> WGS84 longitude/latitude."""
    lic = licences(spark, sf).where(F.col("x_5174").isNotNull()).select("unique_id", "x_5174", "y_5174")
    return geo.plane_to_geographic(lic, "x_5174", "y_5174")


# -------------------------------------------------------- stream and enrich --
def _feed(spark, sf) -> DataFrame:
    """Lookup requests with their stored payloads: the address feed."""
    req = _requests(spark, sf)
    resp = address_responses(spark, sf)
    return req.join(resp, req["uid"] == resp["uid"], "left").select(
        req["uid"].cast("string").alias("uid"), req["id"].cast("string").alias("id"),
        req["full_address"], resp["payload"])


@register("incremental_ingest", with_lic(f"""{DUCK_PARSED}{DUCK_REQ}
SELECT uid, id, full_address, siNm, sggNm, emdNm FROM ({_duck_bronze('req')}) b"""))
def incremental_ingest(spark, sf):
    """The feed written as 4 files, ingested one file per micro-batch;
    returns the silver sink."""
    base = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    _feed(spark, sf).repartition(4).write.mode("overwrite").parquet(f"{base}/feed")
    q = ingest.start_address_ingest(spark, f"{base}/feed", f"{base}/bronze", f"{base}/silver",
                                    f"{base}/checkpoint", max_files_per_trigger=1,
                                    state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/silver").select(*ad.SILVER_COLUMNS)


@register("bounded_ingest", with_lic(f"""{DUCK_PARSED}{DUCK_REQ}
, b AS (SELECT uid, id, full_address, siNm, sggNm, emdNm FROM ({_duck_bronze('req')}) b0)
SELECT * FROM b
UNION ALL SELECT 'n' || uid, id, full_address, siNm, sggNm, emdNm FROM b WHERE CAST(uid AS BIGINT) % 10 = 0
UNION ALL SELECT * FROM b WHERE CAST(uid AS BIGINT) % 5 = 0"""))
def bounded_ingest(spark, sf):
    """Y1 with an event time: duplicates in a batch, in a later batch and beyond the watermark.

    The feed comes in four waves, each ingested by a run of its own on one
    checkpoint: all rows, a third of them twice; half of them again six hours
    later; new keys after five days, which move the watermark; and a fifth of
    the first keys again, whose time is over, so they count anew.
    """
    base = scratch_path(spark, f"bounded-{uuid.uuid4().hex}")
    _feed(spark, sf).write.parquet(f"{base}/rows")
    rows, n = spark.read.parquet(f"{base}/rows"), F.col("uid").cast("bigint")

    def at(part, hours):
        return part.withColumn("event_at", F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours)))

    waves = [at(rows, 0).unionByName(at(rows.where(n % 3 == 0), 0)), at(rows.where(n % 2 == 0), 6),
             at(rows.where(n % 10 == 0).withColumn("uid", F.concat(F.lit("n"), "uid")), 120), at(rows.where(n % 5 == 0), 120)]
    for wave in waves:
        wave.write.mode("append").parquet(f"{base}/feed")
        ingest.start_address_ingest(spark, f"{base}/feed", f"{base}/bronze", f"{base}/silver", f"{base}/checkpoint",
                                    state_partitions=spark.sparkContext.defaultParallelism, event_time="event_at").awaitTermination()
    return spark.read.parquet(f"{base}/silver").select(*ad.SILVER_COLUMNS)


@register("bulk_enrich", with_lic(f"""{DUCK_PARSED}{DUCK_REQ}
SELECT * FROM ({_duck_bronze('req')}) b"""))
def bulk_enrich(spark, sf):
    """Address resolution through a caller batch function on Arrow batches."""
    feed = _feed(spark, sf).withColumn("full_address", ad.tx.clean_address(F.col("full_address")))
    return ad.bulk_enrich(feed, ad.payload_lookup, ad.BRONZE_SCHEMA, ["uid", "id", "full_address"])
