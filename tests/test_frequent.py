"""Heavy hitters by sketches (A1, A2, T2): equal to the plain counts, whatever the shape of the frequencies."""
import random
from collections import Counter

import pytest

from bizlens.operators import frequent as fq
from bizlens.operators import names as nm


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(6)


def zipf(n, distinct):
    rnd = random.Random(4)
    return rnd.choices([f"n{i:05d}" for i in range(distinct)], [1 / (i + 1) for i in range(distinct)], k=n)


def want(values, n):
    c = Counter(v for v in values if v is not None)
    return sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]


SHAPES = {
    "zipf": zipf(20_000, 4000) + [None] * 500,
    "hot": ["hot"] * 9000 + zipf(6000, 3000),
    "flat": [f"f{i % 3000}" for i in range(9000)],  # no value stands out: the exact way
    "few": ["a", "b", "a", None, "c", "c"],
    "empty": [],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("tracked", [64, 8192])
def test_most_frequent(spark, shape, tracked):
    values = SHAPES[shape]
    for n in (1, 12):
        got = [tuple(r) for r in fq.most_frequent(table(spark, values), "v", n, tracked).collect()]
        assert sorted(got, key=lambda x: (-x[1], x[0])) == want(values, n)


@pytest.mark.parametrize("shape", SHAPES)
def test_at_least(spark, shape):
    values = SHAPES[shape]
    count = Counter(v for v in values if v is not None)
    for least, tracked in ((2, 64), (3, 8192), (400, 64)):
        got = {r["value"]: r["cnt"] for r in fq.at_least(table(spark, values), "v", least, 32, tracked).collect()}
        assert got == {v: c for v, c in count.items() if c >= least}


@pytest.mark.parametrize("shape", ["zipf", "hot", "flat"])
def test_the_bound_holds_for_all_others(spark, shape):
    values = SHAPES[shape]
    count = Counter(v for v in values if v is not None)
    for report, tracked in ((4, 64), (32, 64), (200, 4096)):
        exact, bound, rows = fq.candidates(table(spark, values), "v", report, tracked)
        got = {r["value"]: r["cnt"] for r in exact.collect()}
        assert rows == sum(count.values()) and all(count[v] == c for v, c in got.items())
        assert len(got) <= fq.PARTS * report and max([c for v, c in count.items() if v not in got], default=0) <= bound


def test_the_sketch_settles_a_skewed_table_alone(spark):
    """With a small sketch, the head of a skewed table is proved without counting every value."""
    values = ["a"] * 9000 + ["b"] * 7000 + zipf(8000, 6000)
    exact, bound, rows = fq.candidates(table(spark, values), "v", 8, 4096)
    top = sorted((r["cnt"] for r in exact.collect()), reverse=True)
    assert exact.count() < len(set(values)) and top[1] > bound


def test_names_by_sketches(spark):
    df = table(spark, SHAPES["zipf"] + ["x"] * 5000).withColumnRenamed("v", "clean_result")
    plain = nm.brand_dictionary(df, top_n=20).collect()
    assert sorted(map(tuple, nm.brand_dictionary(df, top_n=20, sketched=True).collect())) == sorted(map(tuple, plain)) and len(plain) == 20
    assert (sorted(nm.keep_frequent(df, "clean_result", 50, sketched=True).collect())
            == sorted(nm.keep_frequent(df, "clean_result", 50).collect()))


def test_long_values_are_not_sent_to_the_tasks(spark, monkeypatch):
    values = SHAPES["hot"]
    monkeypatch.setattr(fq, "SENT_CHARS", 10)
    assert [tuple(r) for r in fq.most_frequent(table(spark, values), "v", 5).collect()] == want(values, 5)
