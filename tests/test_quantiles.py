import random

import numpy as np
import pytest

from lanewise.functions import quantiles
from lanewise.functions.quantiles import exact_quantiles
from tests.fixtures import rows

WANTED = [0.0, 0.25, 0.5, 0.75, 1.0]
RNG = random.Random(3)
SAMPLES = {
    "one": [4.0],
    "two": [1.0, 2.0],
    "hot value": [7.0] * 700 + [float(i) for i in range(350)],
    "outlier": [float(i) for i in range(999)] + [1e15],
    "random": [RNG.uniform(-1e6, 1e6) for _ in range(5_000)],
    "few values": [float(RNG.randrange(5)) for _ in range(3_000)],
}


def found(spark, values, probabilities=WANTED):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    got = {r["p"]: r["quantile"] for r in rows(exact_quantiles(df, ["x"], probabilities))}
    return [got[p] for p in probabilities]


@pytest.mark.parametrize("name", SAMPLES)
def test_equals_linear_interpolation(spark, name):
    values = SAMPLES[name]
    assert found(spark, values) == pytest.approx(list(np.quantile(values, WANTED)), rel=1e-12)


def test_result_does_not_rest_on_the_sketch(spark, monkeypatch):
    """With a sketch as coarse as it gets, only the ranges change."""
    monkeypatch.setattr(quantiles, "ACCURACY", 1)
    values = SAMPLES["random"]
    assert found(spark, values) == pytest.approx(list(np.quantile(values, WANTED)), rel=1e-12)


@pytest.mark.parametrize("name", SAMPLES)
def test_ranges_are_cut_until_they_are_small(spark, monkeypatch, name):
    monkeypatch.setattr(quantiles, "ORDERED_AT_ONCE", 3)
    values = SAMPLES[name]
    assert found(spark, values) == pytest.approx(list(np.quantile(values, WANTED)), rel=1e-12)


def test_no_task_orders_more_than_the_bound(spark, monkeypatch):
    sizes = []
    put = quantiles._put_in_order
    monkeypatch.setattr(quantiles, "ORDERED_AT_ONCE", 2_000)
    monkeypatch.setattr(
        quantiles,
        "_put_in_order",
        lambda values, ranges, at: (sizes.extend(v[1] for v in ranges.values()), put(values, ranges, at)),
    )
    df = spark.range(0, 1_000_000, numPartitions=8).selectExpr("rand(7) AS x")
    assert len(rows(exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]))) == 3
    assert sizes and max(sizes) <= 2_000


def test_nulls_and_empty_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, None), (3.0, None)], "x double, y double"
    )
    assert rows(exact_quantiles(df, ["x", "y"], [0.5])) == [
        {"metric": "x", "p": 0.5, "quantile": 2.0}
    ]
