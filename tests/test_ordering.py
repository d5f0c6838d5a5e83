"""Global order statistics against plain Python, on skewed data."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbline.functions.ordering import (
    exact_quantiles,
    global_row_number,
    ntile_of,
    running_sums,
    values_at_ranks,
)


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows share one value."""
    rng = random.Random(7)
    return [(i, 5.0 if i % 3 == 0 else round(rng.uniform(0, 100), 2)) for i in range(3001)]


def test_row_number_matches_sorting(spark, skewed):
    df = spark.createDataFrame(skewed, "id int, v double").repartition(7)
    got = global_row_number(df, [F.desc("v"), F.col("id")]).collect()
    want = sorted(skewed, key=lambda x: (-x[1], x[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["row_number"])] == [x[0] for x in want]
    assert sorted(r["row_number"] for r in got) == list(range(1, len(skewed) + 1))


def test_running_sums_match_cumsum(spark, skewed):
    df = spark.createDataFrame(skewed, "id int, v double").repartition(5)
    got = running_sums(df, [F.col("v"), F.col("id")], ["id"]).collect()
    want = sorted(skewed, key=lambda x: (x[1], x[0]))
    sums = dict(zip([x[0] for x in want], np.cumsum([x[0] for x in want])))
    assert {r["id"]: r["cum_id"] for r in got} == sums


def test_running_sums_restart_per_group(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = running_sums(df, [F.col("x")], ["x"], ["g"]).collect()
    for group in "ab":
        own = sorted(x for g, x in rows if g == group)
        expected = dict(zip(own, np.cumsum(own)))
        assert {r["x"]: r["cum_x"] for r in got if r["g"] == group} == expected


def test_quantiles_interpolate_like_numpy(spark, skewed):
    probabilities = [0, 0.1, 0.33, 0.5, 0.66, 0.9, 1]
    df = spark.createDataFrame(skewed, "id int, v double").withColumn("g", F.col("id") % 4)
    for row in exact_quantiles(df, "v", probabilities, ["g"]).collect():
        own = [v for i, v in skewed if i % 4 == row["g"]]
        assert row["n"] == len(own)
        assert row["quantiles"] == pytest.approx(np.quantile(own, probabilities))


def test_quantile_of_digits(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, "v", [0.33]).first()["quantiles"][0] == pytest.approx(2.97)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_values_at_ranks_on_any_list(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranks = F.array(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.floor(F.col("n") / 2).cast("long"))
    row = values_at_ranks(df, "v", ranks).first()
    ordered = sorted(values)
    assert row["ranked"][0] == ordered[0]
    assert row["ranked"][len(values) - 1] == ordered[-1]
    assert row["ranked"][len(values) // 2] == ordered[len(values) // 2]


@pytest.mark.parametrize("rows", [3, 10, 13, 27])
def test_ntile_sizes(spark, rows):
    df = spark.range(1, rows + 1).withColumn("t", ntile_of(F.col("id"), F.lit(rows), 10))
    df.createOrReplaceTempView("tiles")
    want = spark.sql("select id, ntile(10) over (order by id) t from tiles").collect()
    assert {r["id"]: r["t"] for r in df.collect()} == {r["id"]: r["t"] for r in want}
