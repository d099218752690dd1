from __future__ import annotations

import numpy as np
import pytest

from featurespark.operators import quantiles
from featurespark.operators.quantiles import exact_quantiles

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    found = exact_quantiles(df, {"x": FRACTIONS})["x"]
    for fraction in FRACTIONS:
        assert found[fraction] == pytest.approx(np.quantile(values, fraction), rel=1e-12, abs=1e-12), fraction


CASES = {
    "uniform": lambda rng: rng.uniform(-5, 5, 3000),
    "hot third": lambda rng: np.concatenate([np.full(1000, 2.5), rng.normal(2.5, 0.01, 2000)]),
    "two values": lambda rng: np.repeat([1.0, 2.0], [1500, 1501]),
    "heavy tail": lambda rng: np.exp(rng.normal(0, 20, 2500)),
    "one row": lambda rng: np.array([4.0]),
    "even": lambda rng: np.arange(1000.0),
}


@pytest.mark.parametrize("case", CASES)
def test_quantiles(spark, case):
    check(spark, CASES[case](np.random.default_rng(3)))


@pytest.mark.parametrize("case", ["uniform", "hot third", "heavy tail", "even"])
def test_quantiles_by_repeated_narrowing(spark, monkeypatch, case):
    """With tiny limits every round of cutting and sampling takes place, and the answers stay exact."""
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(quantiles, "MAX_INSIDE", 5)
    check(spark, CASES[case](np.random.default_rng(4)))


def test_several_columns_and_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 10.0, None), (2, float("nan"), None), (3, 30.0, None), (4, None, None)], "a int, b double, c double"
    )
    found = exact_quantiles(df, {"a": [0.5], "b": [0.5], "c": [0.5]})
    assert found == {"a": {0.5: 2.5}, "b": {0.5: 20.0}, "c": {}}
    assert exact_quantiles(df, {}) == {}
