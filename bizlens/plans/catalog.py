"""Registered queries: one per operator row of the survey, each with its
DuckDB oracle SQL (omitted only for model training, streaming and other
non-SQL operators, which get a rows-only check).

Every query derives its input from the driver's tables under ``sf_dir``
(``lic``/``responses`` are derived views, see ``sources.licences``) and runs
over all rows.  Parameters below are the ones that make each threshold bite on
the test data (FIXTURES.md); the reference defaults live on the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features as feat
from ..operators import filters as flt
from ..operators import joins as jn
from ..operators import names as nm
from ..operators import summaries as sm
from ..sources.licences import licences, oracle_prelude
from . import duck

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

# Parameters that make thresholds bite at sf0.01 (reference default in comment).
WINDOW_YEAR = 1998        # 2020
DICT_TOP_N = 12           # 500 (stand-alone dictionary query)
PIPE_TOP_N = 14           # 500 (inside the name pipeline)
MIN_BRAND_FREQ = 500      # 500
FRANCHISE_MIN = 600       # 20
RARE_CLOSURES = 950       # 100
SAMPLE_TARGET = 4000      # 1 000 000 / 700 000


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def with_lic(body: str, names: bool = False, extra: str = "") -> str:
    """Oracle SQL: the lic/responses CTEs, optional name-pipeline CTEs, body."""
    head = oracle_prelude().rstrip()
    if names:
        head += duck.names_ctes(PIPE_TOP_N, MIN_BRAND_FREQ)
    if extra:
        head += extra
    return head + "\n" + body


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return nm.final_name_table(licences(spark, sf, by_key=True), top_n=PIPE_TOP_N, min_freq=MIN_BRAND_FREQ)


# ---------------------------------------------------------------- flagship --
def _model_table(spark: SparkSession, sf: str) -> DataFrame:
    lic = licences(spark, sf)
    model = flt.in_window(lic, "closure_date", WINDOW_YEAR)
    flag = feat.franchise_flag(_names(spark, sf), min_count=FRANCHISE_MIN)
    return jn.left_join_default(model, flag, "unique_id", {"is_franchise": 0})


@register("closure_by_franchise", with_lic("""
, flag AS (SELECT n3.unique_id, CASE WHEN f.clean_name IS NOT NULL THEN 1 ELSE 0 END AS is_franchise
           FROM n3 LEFT JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {fm}) f
           ON n3.clean_name = f.clean_name),
model AS (SELECT l.*, coalesce(f.is_franchise, 0) AS is_franchise FROM lic l LEFT JOIN flag f ON l.unique_id = f.unique_id
          WHERE l.closure_date >= DATE '{y}-01-01' OR l.closure_date IS NULL)
SELECT service, is_franchise, CAST(count(*) AS BIGINT) AS n_stores, CAST(sum(closed) AS BIGINT) AS n_closed,
       round(sum(closed) / count(*), 6) AS closure_rate
FROM model GROUP BY service, is_franchise""".format(fm=FRANCHISE_MIN, y=WINDOW_YEAR), names=True))
def closure_by_franchise(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: closure rate by industry and franchise flag over the
    observation window (F1 -> N1..N3 -> A3 -> J1 -> aggregate)."""
    return sm.closure_summary(_model_table(spark, sf), ["service", "is_franchise"], rollup=False)


# ---------------------------------------------------------------- filters --
@register("window_filter", with_lic(f"""
SELECT unique_id, service, closed, closure_date FROM lic
WHERE closure_date >= DATE '{WINDOW_YEAR}-01-01' OR closure_date IS NULL"""))
def window_filter(spark, sf):
    return flt.in_window(licences(spark, sf), "closure_date", WINDOW_YEAR).select(
        "unique_id", "service", "closed", "closure_date")


@register("needs_lookup", with_lic("""
SELECT unique_id, road_address FROM lic
WHERE (x_5174 IS NULL OR y_5174 IS NULL) AND road_address IS NOT NULL AND trim(road_address) <> ''"""))
def needs_lookup(spark, sf):
    return flt.needs_address_lookup(licences(spark, sf), "x_5174", "y_5174", "road_address").select(
        "unique_id", "road_address")


@register("numeric_filter", with_lic(f"""
SELECT unique_id, c1 AS clean_name FROM ({duck.clean_name_select('lic')}) t WHERE {duck.not_numeric('c1')}"""))
def numeric_filter(spark, sf):
    df = licences(spark, sf).select("unique_id", tx.clean_business_name("bizname").alias("clean_name"))
    return flt.keep_not_numeric(df, "clean_name")


# ---------------------------------------------------------- text functions --
@register("clean_name", with_lic(f"""
SELECT unique_id, bizname, c1 AS clean_name FROM ({duck.clean_name_select('lic')}) t"""))
def clean_name(spark, sf):
    return licences(spark, sf).select("unique_id", "bizname",
                                      tx.clean_business_name("bizname").alias("clean_name"))


@register("recover_latin", with_lic(f"""
SELECT unique_id, bizname, c2 AS recovered FROM ({duck.clean_name_select('lic')}) t"""))
def recover_latin(spark, sf):
    return licences(spark, sf).select("unique_id", "bizname",
                                      tx.recover_parenthesised_latin("bizname").alias("recovered"))


@register("strip_corp", with_lic(f"""
SELECT unique_id, bizname, {duck.strip_corp('bizname')} AS stripped FROM lic"""))
def strip_corp(spark, sf):
    return licences(spark, sf).select("unique_id", "bizname", tx.strip_corp_tokens("bizname").alias("stripped"))


@register("special_tokens", with_lic(f"""
SELECT unique_id, bizname, {duck.special_tokens('lower(bizname)')} AS cleaned FROM lic"""))
def special_tokens(spark, sf):
    return licences(spark, sf).select("unique_id", "bizname",
                                      tx.clean_special_tokens(F.lower("bizname")).alias("cleaned"))


@register("brand_standardise", with_lic(f"""
SELECT unique_id, c1 AS clean_name, {duck.brand_map('c1')} AS brand FROM ({duck.clean_name_select('lic')}) t"""))
def brand_standardise(spark, sf):
    c1 = tx.clean_business_name("bizname")
    return licences(spark, sf).select("unique_id", c1.alias("clean_name"), tx.standardise_brand(c1).alias("brand"))


@register("script_boundary", with_lic(f"""
SELECT unique_id, bizname, {duck.script_boundary('bizname')} AS joined FROM lic"""))
def script_boundary(spark, sf):
    return licences(spark, sf).select("unique_id", "bizname", tx.join_script_boundary("bizname").alias("joined"))


@register("clean_address", with_lic(f"""
SELECT unique_id, road_address, {duck.clean_address('road_address')} AS full_address FROM lic"""))
def clean_address(spark, sf):
    return licences(spark, sf).select("unique_id", "road_address",
                                      tx.clean_address("road_address").alias("full_address"))


# ------------------------------------------------------------ name pipeline --
@register("names_stage1", with_lic("SELECT * FROM n1", names=True))
def names_stage1(spark, sf):
    return nm.clean_names(licences(spark, sf))


@register("names_stage2", with_lic("SELECT * FROM n2", names=True))
def names_stage2(spark, sf):
    return nm.resolve_held_names(nm.clean_names(licences(spark, sf)), top_n=PIPE_TOP_N, min_freq=MIN_BRAND_FREQ)


@register("names_stage3", with_lic("SELECT * FROM n3", names=True))
def names_stage3(spark, sf):
    return _names(spark, sf)


_DICTIONARY = with_lic(f"""
, v AS (SELECT clean_result AS brand, count(*) AS cnt FROM n2rest WHERE length(clean_result) >= 2
        GROUP BY clean_result ORDER BY cnt DESC, brand ASC LIMIT {DICT_TOP_N})
SELECT brand, CAST(cnt AS BIGINT) AS cnt,
       CAST(row_number() OVER (ORDER BY length(brand) DESC, cnt DESC, brand ASC) AS INTEGER) AS match_order FROM v""",
                       names=True)


@register("brand_dictionary", _DICTIONARY)
def brand_dictionary(spark, sf):
    _, _, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), DICT_TOP_N)
    return dictionary


@register("brand_dictionary_sketched", _DICTIONARY)
def brand_dictionary_sketched(spark, sf):
    """A1 + T2 through frequent-items sketches: the shuffle holds sketches, not the distinct names."""
    rest, _, _ = nm.hold_branches(nm.clean_names(licences(spark, sf)), DICT_TOP_N)
    return nm.brand_dictionary(rest, "clean_result", DICT_TOP_N, sketched=True)


@register("dictionary_match", with_lic("""
SELECT h.unique_id, h.hold_text, b.brand FROM n2hold h LEFT JOIN n2best b ON h.unique_id = b.unique_id""",
                                          names=True))
def dictionary_match(spark, sf):
    """J5 in place: no row moves."""
    _, held, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), PIPE_TOP_N)
    return nm.first_entry(held.select("unique_id", "hold_text"), "hold_text", dictionary)


@register("dictionary_match_indexed", with_lic("""
SELECT h.unique_id, h.hold_text, b.brand FROM n2hold h JOIN n2best b ON h.unique_id = b.unique_id""", names=True))
def dictionary_match_indexed(spark, sf):
    """J5 by the position index, the way of large dictionaries."""
    _, held, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), PIPE_TOP_N)
    return nm.match_by_position(held, "hold_text", dictionary, keep=("unique_id", "hold_text"))


_FREQUENT = with_lic(f"""
SELECT unique_id, brand FROM n2best WHERE brand IN
  (SELECT brand FROM n2best GROUP BY brand HAVING count(*) >= {MIN_BRAND_FREQ})""", names=True)


@register("frequent_brands", _FREQUENT)
def frequent_brands(spark, sf):
    _, held, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), PIPE_TOP_N)
    best = nm.match_dictionary(held, "hold_text", dictionary, keep=("unique_id",))
    return nm.keep_frequent(best, "brand", MIN_BRAND_FREQ).select("unique_id", "brand")


@register("frequent_brands_sketched", _FREQUENT)
def frequent_brands_sketched(spark, sf):
    """A2 through frequent-items sketches."""
    _, held, dictionary = nm.hold_branches(nm.clean_names(licences(spark, sf)), PIPE_TOP_N)
    best = nm.match_dictionary(held, "hold_text", dictionary, keep=("unique_id",))
    return nm.keep_frequent(best, "brand", MIN_BRAND_FREQ, sketched=True).select("unique_id", "brand")


# ----------------------------------------------------------------- features --
@register("franchise_flag", with_lic(f"""
SELECT n3.unique_id, CASE WHEN f.clean_name IS NOT NULL THEN 1 ELSE 0 END AS is_franchise
FROM n3 LEFT JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {FRANCHISE_MIN}) f
ON n3.clean_name = f.clean_name""", names=True))
def franchise_flag(spark, sf):
    return feat.franchise_flag(_names(spark, sf), min_count=FRANCHISE_MIN)


@register("left_join_default", with_lic(f"""
, flag AS (SELECT n3.unique_id, CASE WHEN f.clean_name IS NOT NULL THEN 1 ELSE 0 END AS is_franchise
           FROM n3 LEFT JOIN (SELECT clean_name FROM n3 GROUP BY clean_name HAVING count(*) >= {FRANCHISE_MIN}) f
           ON n3.clean_name = f.clean_name)
SELECT l.unique_id, l.service, l.closed, coalesce(f.is_franchise, 0) AS is_franchise
FROM lic l LEFT JOIN flag f ON l.unique_id = f.unique_id
WHERE l.closure_date >= DATE '{WINDOW_YEAR}-01-01' OR l.closure_date IS NULL""", names=True))
def left_join_default(spark, sf):
    return _model_table(spark, sf).select("unique_id", "service", "closed", "is_franchise")
