"""Registered queries: address layer, sampling, metrics, summaries, relational
helpers.  See ``catalog`` for the conventions."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import duck_hash, seeded_hash
from ..operators import address as ad
from ..operators import features as feat
from ..operators import filters as flt
from ..operators import frequent as fq
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import paging as pg
from ..operators import sampling as sp
from ..operators import summaries as sm
from ..session import scratch_path
from ..sources.licences import address_responses, licences
from ..sources.tables import enforce_schema, read_source, write_colocated
from . import duck
from .catalog import (FRANCHISE_MIN, RARE_CLOSURES, SAMPLE_TARGET, WINDOW_YEAR, _names, register,
                      with_lic)

SPLIT_SEED = 42
SAMPLE_SEED = 43
SCORE_SEED = 7
AS_OF = "2000-01-01"
SURVIVAL_YEARS = (1, 3, 5)


# ------------------------------------------------------------ address layer --
def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """F2 rows as lookup requests: uid, id (row number = licence id), raw address."""
    lic = flt.needs_address_lookup(licences(spark, sf), "x_5174", "y_5174", "road_address")
    return lic.select(F.col("unique_id").alias("uid"), F.col("unique_id").alias("id"),
                      F.col("road_address").alias("full_address"))


DUCK_PARSED = f"""
, rp AS (SELECT uid, regexp_replace({duck.py_strip('payload')}, '^\\((.*)\\)$', '\\1', 's') AS j FROM responses),
rj AS (SELECT uid, j, unnest(json_extract(j, '$.results.juso[*]')) AS js FROM rp
       WHERE json_array_length(json_extract(j, '$.results.juso')) > 0
         AND json_type(j, '$.results.common') = 'OBJECT'
         AND json_extract_string(j, '$.results.common.totalCount') IS DISTINCT FROM '0'),
parsed AS (SELECT uid, {', '.join(f"json_extract_string(j, '$.results.common.{c}') AS {c}" for c in ad.COMMON_FIELDS)},
   {', '.join(f"json_extract_string(js, '$.{c}') AS {c}" for c in ad.JUSO_FIELDS)} FROM rj)
"""


@register("parse_response", with_lic(f"""{DUCK_PARSED}
SELECT uid, totalCount, currentPage, countPerPage, errorCode, errorMessage, siNm, sggNm, emdNm FROM parsed"""))
def parse_response(spark, sf):
    """S10 over every stored payload."""
    parsed = ad.parse_address_response(address_responses(spark, sf), "payload", keep=["uid"])
    return parsed.select("uid", *ad.COMMON_FIELDS, "siNm", "sggNm", "emdNm")


def _duck_bronze(src: str) -> str:
    cols = []
    for c in ad.BRONZE_COLUMNS:
        if c in ("uid", "id", "full_address"):
            cols.append(f"r.{c}")
        else:
            cols.append(f"p.{c}")
    return f"SELECT {', '.join(cols)} FROM {src} r LEFT JOIN (SELECT CAST(uid AS VARCHAR) AS puid, * FROM parsed) p ON r.uid = p.puid"


DUCK_REQ = f"""
, req AS (SELECT CAST(unique_id AS VARCHAR) AS uid, CAST(unique_id AS VARCHAR) AS id,
                 {duck.clean_address('road_address')} AS full_address
          FROM lic WHERE (x_5174 IS NULL OR y_5174 IS NULL) AND road_address IS NOT NULL AND trim(road_address) <> '')
"""


@register("resolve_address", with_lic(f"""{DUCK_PARSED}{DUCK_REQ}
{_duck_bronze('req')}"""))
def resolve_address(spark, sf):
    """Lookup requests resolved against stored responses (bronze layout)."""
    return ad.resolve_address(_requests(spark, sf), address_responses(spark, sf))


@register("address_silver", with_lic(f"""{DUCK_PARSED}{DUCK_REQ}
SELECT uid, id, full_address, siNm, sggNm, emdNm FROM ({_duck_bronze('req')}) b"""))
def address_silver(spark, sf):
    """S7 silver projection of the resolved addresses."""
    return ad.resolve_address(_requests(spark, sf), address_responses(spark, sf)).select(*ad.SILVER_COLUMNS)


@register("dedup_first", with_lic(f"""{DUCK_PARSED}
, reqall AS (SELECT CAST(unique_id AS VARCHAR) AS uid, CAST(unique_id AS VARCHAR) AS id,
                    {duck.clean_address('road_address')} AS full_address
             FROM lic WHERE (x_5174 IS NULL OR y_5174 IS NULL) AND road_address IS NOT NULL AND trim(road_address) <> ''
             UNION ALL
             SELECT CAST(unique_id AS VARCHAR), CAST(unique_id + 1 AS VARCHAR), {duck.clean_address('road_address')}
             FROM lic WHERE road_address IS NOT NULL),
b AS ({_duck_bronze('reqall')})
SELECT uid, id, full_address, siNm, sggNm, emdNm FROM (
  SELECT *, row_number() OVER (PARTITION BY uid, full_address ORDER BY CAST(id AS BIGINT)) AS dedup_rank FROM b) t WHERE dedup_rank = 1"""))
def dedup_first(spark, sf):
    """Two lookup runs (F2 rows, then every addressed licence with a later
    row number) deduplicated first-wins on (uid, full_address)."""
    lic = licences(spark, sf)
    run2 = lic.where(F.col("road_address").isNotNull()).select(
        F.col("unique_id").alias("uid"), (F.col("unique_id") + 1).alias("id"),
        F.col("road_address").alias("full_address"))
    responses = address_responses(spark, sf)
    both = ad.resolve_address(_requests(spark, sf), responses).unionByName(ad.resolve_address(run2, responses))
    silver = both.select(*ad.SILVER_COLUMNS).withColumn("_ord", F.col("id").cast("bigint"))
    return ad.dedup_first(silver, ["uid", "full_address"], "_ord").drop("_ord")


@register("ingest_stamp", with_lic("""
SELECT unique_id, strftime(CAST(license_date AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at
FROM lic"""))
def ingest_stamp(spark, sf):
    """Seoul wall-clock stamp of an instant (here: licence date 00:00 UTC)."""
    lic = licences(spark, sf)
    instant = F.make_timestamp(F.year("license_date"), F.month("license_date"), F.dayofmonth("license_date"),
                               F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return lic.select("unique_id", ad.ingest_stamp(instant).alias("created_at"))


# ---------------------------------------------------------------- sampling --
def _h(seed):
    return duck_hash("unique_id", seed)


@register("stratified_split", with_lic(f"""
SELECT unique_id, service, closed,
  row_number() OVER (PARTITION BY service, closed ORDER BY {_h(SPLIT_SEED)}, unique_id)
    <= round(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY service, closed)) AS is_test
FROM lic"""))
def stratified_split(spark, sf):
    """90:10 split stratified by (industry, label)."""
    lic = licences(spark, sf).select("unique_id", "service", "closed")
    return sp.stratified_split(lic, ["service", "closed"], 0.1, "unique_id", SPLIT_SEED)


DUCK_TRAIN = f"""
, test AS (SELECT unique_id FROM (SELECT unique_id,
  row_number() OVER (PARTITION BY service, closed ORDER BY {_h(SPLIT_SEED)}, unique_id)
    <= round(CAST(0.1 AS DOUBLE) * count(*) OVER (PARTITION BY service, closed)) AS t FROM lic) x WHERE t),
train AS (SELECT unique_id, service, closed FROM lic WHERE unique_id NOT IN (SELECT unique_id FROM test))
"""


def _train(spark, sf):
    """Training set = licences minus the stratified test set (anti join)."""
    lic = licences(spark, sf).select("unique_id", "service", "closed")
    test = sp.stratified_split(lic, ["service", "closed"], 0.1, "unique_id", SPLIT_SEED).where("is_test")
    return jn.complement(lic, test, "unique_id")


@register("anti_complement", with_lic(f"{DUCK_TRAIN}\nSELECT * FROM train"))
def anti_complement(spark, sf):
    """Training set = all minus the stratified test set (left anti join)."""
    return _train(spark, sf)


@register("sample_to", with_lic(f"""{DUCK_TRAIN}
SELECT unique_id, closed FROM (SELECT unique_id, closed,
  row_number() OVER (PARTITION BY closed ORDER BY {_h(SAMPLE_SEED)}, unique_id) AS rn,
  least(round(CAST({SAMPLE_TARGET} AS DOUBLE) * count(*) OVER (PARTITION BY closed) / count(*) OVER ()),
        count(*) OVER (PARTITION BY closed)) AS k FROM train) t WHERE rn <= k"""))
def sample_to(spark, sf):
    """Class-proportional exact sample of the training set."""
    s = sp.sample_to(_train(spark, sf), ["closed"], SAMPLE_TARGET, "unique_id", SAMPLE_SEED)
    return s.where("sampled").select("unique_id", "closed")


@register("undersample", with_lic(f"""
SELECT unique_id, closed FROM (SELECT unique_id, closed,
  row_number() OVER (PARTITION BY closed ORDER BY {_h(SAMPLE_SEED)}, unique_id) AS rn FROM lic) t
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM lic GROUP BY closed) m)"""))
def undersample(spark, sf):
    """Majority class cut to the minority size."""
    lic = licences(spark, sf).select("unique_id", "closed")
    return sp.undersample(lic, "closed", "unique_id", SAMPLE_SEED).where("kept").select("unique_id", "closed")


def _duck_draws(n_draws_sql: str) -> str:
    return f"""
, minority AS (SELECT unique_id, closed FROM lic WHERE closed = 1),
midx AS (SELECT unique_id, closed, row_number() OVER (ORDER BY {_h(SAMPLE_SEED)}, unique_id) - 1 AS idx FROM minority),
draws AS (SELECT draw, {duck_hash('draw', f'draw{SAMPLE_SEED}')} % (SELECT count(*) FROM minority) AS idx
          FROM (SELECT unnest(range(({n_draws_sql}))) AS draw) r)
"""


@register("oversample_bootstrap", with_lic(_duck_draws("SELECT count(*) FROM lic WHERE closed = 0") + """
SELECT unique_id, closed, CAST(NULL AS BIGINT) AS draw FROM lic WHERE closed = 0
UNION ALL SELECT m.unique_id, m.closed, d.draw FROM draws d JOIN midx m ON d.idx = m.idx"""))
def oversample_bootstrap(spark, sf):
    """Minority replaced by n_major draws with replacement."""
    lic = licences(spark, sf).select("unique_id", "closed")
    return sp.oversample(lic, "closed", "unique_id", SAMPLE_SEED, keep_originals=False)


@register("oversample_keep", with_lic(
    _duck_draws("SELECT (SELECT count(*) FROM lic WHERE closed = 0) - (SELECT count(*) FROM lic WHERE closed = 1)")
    + """
SELECT unique_id, closed, CAST(NULL AS BIGINT) AS draw FROM lic
UNION ALL SELECT m.unique_id, m.closed, d.draw FROM draws d JOIN midx m ON d.idx = m.idx"""))
def oversample_keep(spark, sf):
    """All originals plus n_major - n_minor draws."""
    lic = licences(spark, sf).select("unique_id", "closed")
    return sp.oversample(lic, "closed", "unique_id", SAMPLE_SEED, keep_originals=True)


@register("class_weights", with_lic("""
SELECT closed, CAST(count(*) AS BIGINT) AS n_c,
  CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM lic GROUP BY closed"""))
def class_weights(spark, sf):
    """Balanced class weights n / (k * n_c)."""
    return sp.class_weights(licences(spark, sf), "closed")


# ----------------------------------------------------------------- metrics --
def _pred(spark, sf):
    """A deterministic prediction table derived from the licences: label =
    closed, score mixes a seeded hash with the label (so AUC > 0.5)."""
    lic = licences(spark, sf)
    p = (F.pmod(seeded_hash("unique_id", SCORE_SEED), F.lit(1000)) + 300 * F.col("closed")).cast("double") / 1300.0
    return lic.select("unique_id", F.col("closed").alias("y"), p.alias("p")).withColumn(
        "yhat", F.when(F.col("p") >= 0.5, 1).otherwise(0))


DUCK_PRED = f"""
, pred AS (SELECT unique_id, y, p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM (
    SELECT unique_id, closed AS y, CAST({_h(SCORE_SEED)} % 1000 + 300 * closed AS DOUBLE) / CAST(1300.0 AS DOUBLE) AS p
    FROM lic) t),
sc AS (SELECT p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
       FROM pred GROUP BY p),
cum AS (SELECT score, pos, neg,
   coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
   coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)
"""


@register("confusion", with_lic(f"""{DUCK_PRED}
SELECT y AS label, CAST(sum(CASE WHEN yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(sum(CASE WHEN yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1,
       CAST(sum(CASE WHEN yhat NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS pred_other FROM pred GROUP BY y"""))
def confusion(spark, sf):
    """Confusion matrix with explicit labels."""
    return mt.confusion_matrix(_pred(spark, sf), "y", "yhat", (0, 1))


@register("class_report", with_lic(f"""{DUCK_PRED}
, cells AS (SELECT y, yhat, count(*) AS c FROM pred GROUP BY y, yhat),
k AS (SELECT y AS k FROM cells UNION SELECT yhat FROM cells),
per AS (SELECT k.k, coalesce((SELECT sum(c) FROM cells WHERE y = k.k), 0) AS support,
               coalesce((SELECT sum(c) FROM cells WHERE yhat = k.k), 0) AS predicted,
               coalesce((SELECT sum(c) FROM cells WHERE y = k.k AND yhat = k.k), 0) AS tp FROM k),
pr AS (SELECT k, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM (
  SELECT CAST(k AS VARCHAR) AS label, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f) u"""))
def class_report(spark, sf):
    """Classification report (precision, recall, F1, support)."""
    return mt.classification_report(_pred(spark, sf), "y", "yhat")


@register("roc_auc", with_lic(f"""{DUCK_PRED}
SELECT CAST(sum(2 * pos * neg_below + pos * neg) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum"""))
def roc_auc(spark, sf):
    """Exact tie-aware ROC-AUC."""
    return mt.roc_auc(_pred(spark, sf), "y", "p")


@register("roc_points", with_lic(f"""{DUCK_PRED}
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT score, CAST(N - neg_below AS DOUBLE) / N, CAST(P - pos_below AS DOUBLE) / P FROM cum"""))
def roc_points(spark, sf):
    """ROC curve points."""
    return mt.roc_curve(_pred(spark, sf), "y", "p")


@register("pr_points", with_lic(f"""{DUCK_PRED}
SELECT score AS threshold, CAST(P - pos_below AS DOUBLE) / ((P - pos_below) + (N - neg_below)) AS precision,
       CAST(P - pos_below AS DOUBLE) / P AS recall
FROM cum
UNION ALL SELECT NULL, 1.0, 0.0"""))
def pr_points(spark, sf):
    """A10: precision-recall curve points."""
    return mt.pr_curve(_pred(spark, sf), "y", "p")


@register("score_hist", with_lic(f"""{DUCK_PRED}
SELECT y AS label, CAST(least(greatest(floor(p * 20), 0), 19) AS INTEGER) AS bin, count(*) AS n
FROM pred GROUP BY 1, 2"""))
def score_hist(spark, sf):
    """Predicted-probability histogram per true class (20 bins)."""
    return mt.score_histogram(_pred(spark, sf), "y", "p", bins=20)


# --------------------------------------------------------------- summaries --
@register("rare_category", with_lic(f"""
SELECT unique_id, service, closed FROM lic
WHERE service IN (SELECT service FROM lic GROUP BY service HAVING sum(closed) > {RARE_CLOSURES})"""))
def rare_category(spark, sf):
    """drop industries with at most N closures."""
    lic = licences(spark, sf).select("unique_id", "service", "closed")
    return sm.drop_rare(lic, "service", "closed", RARE_CLOSURES)


@register("period_bucket", with_lic(f"""
SELECT unique_id, d AS operating_days,
  CASE WHEN d < 365 THEN '<1y' WHEN d < 1095 THEN '1-3y' WHEN d < 1825 THEN '3-5y' WHEN d < 3650 THEN '5-10y'
       WHEN d IS NOT NULL THEN '10y+' END AS operating_bucket
FROM (SELECT unique_id, CAST(date_diff('day', license_date, coalesce(closure_date, DATE '{AS_OF}')) AS INTEGER) AS d FROM lic) t"""))
def period_bucket(spark, sf):
    """C14: operating-period buckets (edges 1/3/5/10 years)."""
    d = feat.operating_days("license_date", "closure_date", AS_OF)
    lic = licences(spark, sf).select("unique_id", d.alias("operating_days"))
    return lic.select("unique_id", "operating_days", feat.period_bucket(F.col("operating_days")).alias("operating_bucket"))


@register("closure_rollup", with_lic("""
SELECT sido, service, CAST(count(*) AS BIGINT) AS n_stores, CAST(sum(closed) AS BIGINT) AS n_closed,
  CAST(grouping(sido, service) AS INTEGER) AS level, round(sum(closed) / count(*), 6) AS closure_rate
FROM lic GROUP BY ROLLUP (sido, service)"""))
def closure_rollup(spark, sf):
    """Region x industry closure table with subtotals."""
    return sm.closure_summary(licences(spark, sf), ["sido", "service"], rollup=True)


def _duck_survival() -> str:
    parts = []
    for n in SURVIVAL_YEARS:
        obs = f"(license_date + {n * 365}) <= DATE '{AS_OF}'"
        surv = f"{obs} AND (closure_date IS NULL OR closure_date > license_date + {n * 365})"
        parts.append(f"CAST(sum(CASE WHEN {obs} THEN 1 ELSE 0 END) AS BIGINT) AS n_obs_{n}y")
        parts.append(f"round(sum(CASE WHEN {surv} THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {obs} THEN 1 ELSE 0 END), 0), 6)"
                     f" AS survival_{n}y")
    return ",\n  ".join(parts)


@register("survival", with_lic(f"""
SELECT service, CAST(count(*) AS BIGINT) AS n_stores,
  round(avg(date_diff('day', license_date, coalesce(closure_date, DATE '{AS_OF}'))), 6) AS avg_days,
  round(avg(CASE WHEN closure_date IS NOT NULL THEN date_diff('day', license_date, closure_date) END), 6) AS avg_days_closed,
  {_duck_survival()}
FROM lic GROUP BY service"""))
def survival(spark, sf):
    """Operating duration and 1/3/5-year survival per industry."""
    return sm.survival_summary(licences(spark, sf), ["service"], "license_date", "closure_date",
                               AS_OF, SURVIVAL_YEARS)


@register("quarterly_trend", with_lic("""
, q AS (SELECT sido, CAST(date_trunc('quarter', license_date) AS DATE) AS quarter, count(*) AS value
        FROM lic GROUP BY 1, 2)
SELECT q.sido, q.quarter, CAST(q.value AS BIGINT) AS value, CAST(b.value AS BIGINT) AS prev_value,
       CAST(q.value - b.value AS BIGINT) AS change, round((q.value - b.value) / b.value, 6) AS change_rate
FROM q LEFT JOIN q b ON b.sido = q.sido AND b.quarter + INTERVAL 3 MONTH = q.quarter"""))
def quarterly_trend(spark, sf):
    """New licences per region and quarter, change vs previous quarter."""
    return sm.quarterly_trend(licences(spark, sf), ["sido"], "license_date")


# ------------------------------------------------------ relational helpers --
EMB_DIM = 64


def _duck_flat(alias: str = "e") -> str:
    return ", ".join(f"CAST({alias}.embedding[{i + 1}] AS DOUBLE) AS embedding_{i}" for i in range(EMB_DIM))


@register("flatten_embedding", with_lic(f"""
SELECT e.vec_id, e.label, {_duck_flat()} FROM embeddings e"""))
def flatten_embedding(spark, sf):
    """array<float>(64) -> embedding_0..63."""
    emb = read_source(spark, sf, "embeddings")
    return feat.flatten_array(emb, "embedding", "embedding_", EMB_DIM, keep=["vec_id", "label"])


@register("prefix_join", with_lic(f"""
, flat AS (SELECT e.vec_id, {_duck_flat()} FROM embeddings e)
SELECT l.unique_id, l.service, {', '.join(f'coalesce(f.embedding_{i}, 0.0) AS embedding_{i}' for i in range(EMB_DIM))}
FROM lic l LEFT JOIN flat f ON l.unique_id = f.vec_id"""))
def prefix_join(spark, sf):
    """Every embedding_* column left-joined by id, missing -> 0.0."""
    emb = read_source(spark, sf, "embeddings")
    flat = feat.flatten_array(emb, "embedding", "embedding_", EMB_DIM, keep=[F.col("vec_id").alias("unique_id")])
    lic = licences(spark, sf).select("unique_id", "service")
    return jn.left_join_prefix(lic, flat, "unique_id", "embedding_", 0.0)


@register("colocated_features", with_lic(f"""
, flat AS (SELECT e.vec_id, {_duck_flat()} FROM embeddings e),
flag AS (SELECT n3.unique_id, CASE WHEN f.clean_name IS NOT NULL THEN 1 ELSE 0 END AS is_franchise
         FROM n3 LEFT JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {FRANCHISE_MIN}) f ON n3.clean_name = f.clean_name)
SELECT l.unique_id, l.service, l.closed, coalesce(g.is_franchise, 0) AS is_franchise,
       {', '.join(f'coalesce(f.embedding_{i}, 0.0) AS embedding_{i}' for i in range(EMB_DIM))}
FROM lic l LEFT JOIN flag g ON l.unique_id = g.unique_id LEFT JOIN flat f ON l.unique_id = f.vec_id""", names=True))
def colocated_features(spark, sf):
    """S3 + J1 + J2: licences, flags and vectors saved once in buckets of the licence id; their joins move no row."""
    flags = feat.franchise_flag(_names(spark, sf), min_count=FRANCHISE_MIN)
    lic = licences(spark, sf).select("unique_id", "service", "closed")
    ident = F.col("vec_id").cast(lic.schema["unique_id"].dataType).alias("unique_id")
    flat = feat.flatten_array(read_source(spark, sf, "embeddings"), "embedding", "embedding_", EMB_DIM, keep=[ident])
    tag, saved = uuid.uuid4().hex, {}
    for name, df in (("licences", lic), ("flags", flags), ("vectors", flat)):
        table = f"colocated_{name}_{tag}"
        saved[name] = write_colocated(df, table, "unique_id", path=scratch_path(spark, table))
    flagged = jn.left_join_default(saved["licences"], saved["flags"], "unique_id", {"is_franchise": 0})
    return jn.left_join_prefix(flagged, saved["vectors"], "unique_id", "embedding_", 0.0)


@register("overlay", with_lic(f"""{DUCK_PARSED}
SELECT l.unique_id, coalesce(p.siNm, l.sido) AS sido, coalesce(p.sggNm, l.sigungu) AS sigungu,
       coalesce(p.emdNm, l.dong) AS dong, l.service
FROM lic l LEFT JOIN parsed p ON l.unique_id = p.uid"""))
def overlay(spark, sf):
    """Lookup regions overwrite licence regions where the lookup hit."""
    lic = licences(spark, sf).select("unique_id", "sido", "sigungu", "dong", "service")
    parsed = ad.parse_address_response(address_responses(spark, sf), "payload", keep=["uid"])
    return jn.overlay(lic, parsed.withColumnRenamed("uid", "unique_id"), "unique_id",
                      {"sido": "siNm", "sigungu": "sggNm", "dong": "emdNm"})


@register("assign_batches", with_lic("""
SELECT unique_id, idx, CAST(floor(idx / 1000) AS BIGINT) AS batch_no, CAST(floor((idx % 1000) / 500) AS BIGINT) AS sub_no
FROM (SELECT unique_id, row_number() OVER (ORDER BY unique_id) - 1 AS idx FROM lic) t"""))
def assign_batches(spark, sf):
    """Pages of 1000 rows and sub-pages of 500 in key order, one pass."""
    return pg.assign_batches(licences(spark, sf).select("unique_id"), "unique_id", batch=1000, sub=500)


@register("assign_batches_composite", with_lic("""
SELECT service, unique_id, bizname, idx, CAST(idx // 700 AS BIGINT) AS batch_no, CAST((idx % 700) // 100 AS BIGINT) AS sub_no
FROM (SELECT service, CAST(unique_id AS VARCHAR) AS unique_id, bizname,
             row_number() OVER (ORDER BY service NULLS FIRST, bizname NULLS FIRST, CAST(unique_id AS VARCHAR)) - 1 AS idx FROM lic) t"""))
def assign_batches_composite(spark, sf):
    """Pages in the order of a composite text key that a few values dominate."""
    lic = licences(spark, sf).select("service", F.col("unique_id").cast("string").alias("unique_id"), "bizname")
    return pg.assign_batches(lic, ["service", "bizname", "unique_id"], batch=700, sub=100)


@register("set_difference", with_lic("""
SELECT sigungu, dong FROM lic EXCEPT SELECT sigungu, dong FROM lic WHERE closed = 1 AND license_date < DATE '1995-01-01'"""))
def set_difference(spark, sf):
    """EXCEPT DISTINCT."""
    lic = licences(spark, sf)
    return pg.difference(lic.select("sigungu", "dong"),
                         lic.where((F.col("closed") == 1) & (F.col("license_date") < F.lit("1995-01-01").cast("date")))
                         .select("sigungu", "dong"))


@register("union_all", with_lic("""
SELECT unique_id, service, closed FROM lic WHERE closed = 1
UNION ALL SELECT unique_id, service, closed FROM lic WHERE license_date >= DATE '1997-01-01'"""))
def union_all(spark, sf):
    """Bag union (rows in both inputs appear twice)."""
    lic = licences(spark, sf).select("unique_id", "service", "closed", "license_date")
    return pg.union_all(lic.where("closed = 1").drop("license_date"),
                        lic.where(F.col("license_date") >= F.lit("1997-01-01").cast("date")).drop("license_date"))


@register("top_dongs", with_lic("""
SELECT dong, CAST(sum(closed) AS BIGINT) AS n_closed FROM lic GROUP BY dong ORDER BY n_closed DESC, dong ASC LIMIT 10"""))
def top_dongs(spark, sf):
    """Top-10 areas by closures (a top-k report: the limit is the feature)."""
    agg = licences(spark, sf).groupBy("dong").agg(F.sum("closed").cast("bigint").alias("n_closed"))
    return pg.top_n(agg, 10, [F.desc("n_closed"), F.asc("dong")])


TOP_TOKENS = 50


@register("top_tokens", f"""
SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS token FROM documents) t
GROUP BY token ORDER BY cnt DESC, token ASC LIMIT {TOP_TOKENS}""")
def top_tokens(spark, sf):
    """T2 through sketches: the most frequent words of all documents (a top-k report: the limit is the feature)."""
    words = read_source(spark, sf, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("token")).where("token <> ''")
    return fq.most_frequent(words, "token", TOP_TOKENS).withColumnRenamed("value", "token")


@register("distinct_strata", with_lic("""
SELECT DISTINCT concat_ws('_', CAST(service AS VARCHAR), CAST(closed AS VARCHAR)) AS stratify_col FROM lic"""))
def distinct_strata(spark, sf):
    """A4 + C10: distinct stratum keys."""
    lic = licences(spark, sf).select(feat.stratum_key("service", "closed").alias("stratify_col"))
    return pg.distinct_values(lic, ["stratify_col"])


@register("row_count", with_lic("SELECT count(*) AS n_rows FROM n3", names=True))
def row_count(spark, sf):
    """A5: row count of the final name table."""
    return pg.row_count(_names(spark, sf))


NAME_SCHEMA_COLS = ["unique_id", "bizname", "clean_name", "clean_result"]


@register("final_business_name", with_lic("SELECT * FROM n3", names=True))
def final_business_name(spark, sf):
    """The name table enforced to its declared schema."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("unique_id", T.LongType(), True)]
                          + [T.StructField(c, T.StringType(), True) for c in NAME_SCHEMA_COLS[1:]])
    return enforce_schema(_names(spark, sf), schema)


@register("franchise_window", with_lic(f"""
, flag AS (SELECT n3.unique_id, CASE WHEN f.clean_name IS NOT NULL THEN 1 ELSE 0 END AS is_franchise
           FROM n3 LEFT JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {FRANCHISE_MIN}) f
           ON n3.clean_name = f.clean_name)
SELECT l.sido, coalesce(f.is_franchise, 0) AS is_franchise, CAST(count(*) AS BIGINT) AS n_stores,
       CAST(sum(l.closed) AS BIGINT) AS n_closed, round(sum(l.closed) / count(*), 6) AS closure_rate
FROM lic l LEFT JOIN flag f ON l.unique_id = f.unique_id
WHERE l.closure_date >= DATE '{WINDOW_YEAR}-01-01' OR l.closure_date IS NULL GROUP BY 1, 2""", names=True))
def franchise_window(spark, sf):
    """Closure rate by region and franchise flag in the observation window."""
    from .catalog import _model_table
    return sm.closure_summary(_model_table(spark, sf), ["sido", "is_franchise"], rollup=False)


# ---------------------------------------------------- small operator queries --
@register("scan_licences", with_lic("SELECT * FROM lic"))
def scan_licences(spark, sf):
    """S1 + S2 + S6: the SQL-text licence source over the scanned tables."""
    return licences(spark, sf)


@register("held_names", with_lic("SELECT unique_id, bizname FROM n1 WHERE clean_result = '보류'", names=True))
def held_names(spark, sf):
    """rows held back by stage 1 (null-safe sentinel equality)."""
    from ..operators import names as nm
    stage1 = nm.clean_names(licences(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)
    held, _ = flt.split_hold(stage1, "clean_result")
    return held.select("unique_id", "bizname")


@register("stopword_drop", with_lic(f"""
SELECT unique_id, brand FROM n2best WHERE brand NOT IN ({', '.join(duck.q(w) for w in flt.tx.STOPWORDS)})""",
                                     names=True))
def stopword_drop(spark, sf):
    """F8: matched brands of held rows without stop-words."""
    from ..functions import text as tx
    from ..operators import names as nm
    from .catalog import PIPE_TOP_N
    _, held, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), PIPE_TOP_N)
    best = nm.match_dictionary(held, "hold_text", dictionary, keep=("unique_id",))
    return flt.drop_stopwords(best, "brand")


@register("min_len", with_lic(f"""
SELECT unique_id, c1 AS clean_name FROM ({duck.clean_name_select('lic')}) t
WHERE length({duck.py_strip('c1')}) >= 2"""))
def min_len(spark, sf):
    """F6 (+F7): cleaned names with at least two characters after stripping."""
    df = licences(spark, sf).select("unique_id", flt.tx.clean_business_name("bizname").alias("clean_name"))
    return flt.min_len(flt.drop_nulls(df, ["clean_name"]), "clean_name", 2)


@register("keep_in", with_lic("""
SELECT unique_id, dong FROM lic WHERE dong IN (SELECT dong FROM lic WHERE closed = 1 GROUP BY dong HAVING count(*) >= 12)"""))
def keep_in(spark, sf):
    """membership against a derived value list (semi join, never a collected isin)."""
    lic = licences(spark, sf)
    busy = lic.where("closed = 1").groupBy("dong").count().where(F.col("count") >= 12)
    return flt.keep_in(lic.select("unique_id", "dong"), "dong", busy)


@register("shuffle_rows", with_lic(f"""
SELECT unique_id, {_h(11)} AS shuffle_key FROM lic"""))
def shuffle_rows(spark, sf):
    """Seeded full shuffle = distributed sort by a seeded hash."""
    return sp.shuffle_rows(licences(spark, sf).select("unique_id"), "unique_id", 11)


@register("closure_year", with_lic("""
SELECT CAST(year(closure_date) AS INTEGER) AS closure_year, count(*) AS n FROM lic
WHERE closure_date IS NOT NULL GROUP BY 1"""))
def closure_year(spark, sf):
    """Closures per calendar year."""
    lic = licences(spark, sf).where(F.col("closure_date").isNotNull())
    return lic.groupBy(F.year("closure_date").alias("closure_year")).agg(F.count(F.lit(1)).alias("n"))
