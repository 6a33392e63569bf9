"""Stored-response parsing (S10), null-row misses (J7), dedup (W1), stamp."""
from pyspark.sql import functions as F

from bizlens.operators import address as ad

HIT = '({"results":{"common":{"totalCount":"2","errorCode":"0"},"juso":[{"siNm":"A","sggNm":"B"},{"siNm":"C"}]}})'


def test_parse_response_cases(spark):
    rows = [(1, HIT), (2, '({"results":{"common":{"totalCount":"0"},"juso":[{"siNm":"A"}]}})'),
            (3, '({"results":{"common":{"totalCount":"1"},"juso":[]}})'), (4, "not json"), (5, None),
            (6, '  ({"results":{"common":{"totalCount":"1","errorMessage":null},"juso":[{"siNm":"N","bdNm":null}]}})\n'),
            (7, '{"results":{"common":{"totalCount":"1"},"juso":[{"siNm":"P"}]}}'), (8, '{"other":1}')]
    df = spark.createDataFrame(rows, "uid long, payload string")
    out = ad.parse_address_response(df, "payload", keep=["uid"]).collect()
    got = sorted((r.uid, r.siNm, r.sggNm, r.totalCount) for r in out)
    assert got == [(1, "A", "B", "2"), (1, "C", None, "2"), (6, "N", None, "1"), (7, "P", None, "1")]


def test_resolve_keeps_misses_as_null_rows(spark):
    req = spark.createDataFrame([(1, 10, "a  (b, c)"), (2, 20, "x"), (3, 30, "y")], "uid long, id long, full_address string")
    resp = spark.createDataFrame([(1, HIT), (2, '({"results":{"common":{"totalCount":"0"},"juso":[]}})')],
                                 "uid long, payload string")
    out = ad.resolve_address(req, resp)
    assert out.columns == ad.BRONZE_COLUMNS
    rows = sorted((r.uid, r.id, r.full_address, r.siNm) for r in out.collect())
    assert rows == [("1", "10", "a (b)", "A"), ("1", "10", "a (b)", "C"), ("2", "20", "x", None), ("3", "30", "y", None)]


def test_dedup_first_wins_by_order(spark):
    df = spark.createDataFrame([("u", "a", 3, "late"), ("u", "a", 1, "first"), ("u", "b", 2, "other"), ("v", "a", 5, "v")],
                               "uid string, addr string, ord int, val string")
    out = sorted(tuple(r) for r in ad.dedup_first(df, ["uid", "addr"], "ord").collect())
    assert out == [("u", "a", 1, "first"), ("u", "b", 2, "other"), ("v", "a", 5, "v")]


def test_ingest_stamp_is_zone_correct(spark):
    df = spark.range(1).select(F.make_timestamp(F.lit(2025), F.lit(5), F.lit(23), F.lit(15), F.lit(30), F.lit(0),
                                                F.lit("UTC")).alias("t"))
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Seoul"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(ad.ingest_stamp(F.col("t")).alias("s")).first().s == "2025-05-24 00:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_bulk_enrich_survives_bad_rows(spark):
    import pandas as pd
    from pyspark.sql import types as T

    def fn(pdf):
        if (pdf["x"] == "boom").any():
            raise ValueError("bad row")
        return pd.DataFrame({"k": pdf["k"].astype(object), "y": pdf["x"].str.upper().astype(object)})

    df = spark.createDataFrame([("1", "a"), ("2", "boom"), ("3", "c")], "k string, x string").repartition(1)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("y", T.StringType())])
    out = sorted(tuple(r) for r in ad.bulk_enrich(df, fn, schema, ["k"]).collect())
    assert out == [("1", "A"), ("2", None), ("3", "C")]
