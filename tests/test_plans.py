"""Plan checks: pushdown, no Python in the name pipeline, bounded broadcasts."""
import tempfile

from bizlens.operators import filters as flt
from bizlens.operators import names as nm
from bizlens.sources.licences import licences

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_is_pushed_to_scan(spark):
    path = tempfile.mkdtemp(prefix="bizlens-lic-") + "/lic"
    licences(spark, SF_SMALL).write.mode("overwrite").parquet(path)
    df = flt.in_window(spark.read.parquet(path), "closure_date", 1998)
    plan = _plan(df)
    assert "PushedFilters: [Or(GreaterThanOrEqual(closure_date" in plan or "PushedFilters: [Or(IsNull(closure_date)" in plan


def test_final_name_table_has_no_python_and_no_cross_join(spark):
    df = nm.final_name_table(licences(spark, SF_SMALL), top_n=14, min_freq=1)
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    df.count()
    spark.catalog.clearCache()


def test_dictionary_match_in_place(spark):
    """Both ways give the same first entry, and the one in place moves no row of the texts."""
    from bizlens.operators import names as nm
    entries = ["cu", "ab", "longer name", "씨유", "a b", "e", "", "x1", "카페", "longer"]
    d = spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "brand string, match_order int")
    texts = ["cu 편의점", "xcu", "longer nameab", None, "", "씨유ab", "cu-한강", "a b", "b e", "ex1", "_x1 x1", "카페ab ab", "cu", "nothing", "ab한", "é ab"]
    t = spark.createDataFrame(list(enumerate(texts)), "unique_id long, t string")
    got = nm.match_dictionary(t, "t", d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nm.match_by_position(t, "t", d.where("brand <> ''")).collect()))
    plan = nm.first_entry(t, "t", d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert nm.first_entry(t, "t", d.limit(0)).where("brand IS NOT NULL").count() == 0
