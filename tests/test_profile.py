from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from featurespark.functions.columns import numeric_columns, type_class
from featurespark.functions.numeric import equal_width_edges
from featurespark.operators import profile, states, value_counts
from featurespark.operators.duplicates import duplicate_of
from featurespark.operators.profile import profile_columns, profile_table
from featurespark.errors import DataAccessError


def one(df, **options):
    return profile_columns(df, **options)[0]


def test_types(spark, people):
    classes = {field.name: type_class(field) for field in people.schema.fields}
    assert classes == {
        "age": "float", "income": "integer", "email": "string", "customer_id": "string", "category": "string",
    }
    wide = spark.sql("SELECT true AS b, DATE '2024-01-01' AS d, array(1) AS a, 1.5BD AS n, X'00' AS x")
    assert [type_class(f) for f in wide.schema.fields] == ["boolean", "datetime", "unknown", "float", "unknown"]
    assert numeric_columns(wide) == ["n"]


def test_profile_of_people(people):
    profiles = {p.name: p for p in profile_columns(people)}
    assert list(profiles) == people.columns
    income = profiles["income"]
    assert (income.null_count, round(income.mean, 3), income.min, income.max) == (0, 47231.833, 40000.0, 53997.0)
    assert not income.is_constant
    assert profiles["age"].null_count == 1 and profiles["age"].null_percentage == 8.3333
    assert profiles["category"].mode == "north" and profiles["category"].unique_count == 3


def pandas_numbers(series):
    series = series.dropna()
    counts, edges = pd.cut(series, bins=10, retbins=True, duplicates="drop")
    return {
        "mean": series.mean(), "median": series.median(), "std": series.std(), "min": series.min(),
        "max": series.max(), "skewness": series.skew(), "kurtosis": series.kurt(),
        "p25": series.quantile(0.25), "p75": series.quantile(0.75), "unique": series.nunique(),
        "counts": counts.value_counts(sort=False).tolist(), "edges": edges.tolist(),
    }


@pytest.mark.parametrize("kind", ["normal", "few values", "heavy tail", "mostly one value", "integers"])
def test_numbers_equal_pandas(spark, kind):
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(3, 2, 2001),
        "few values": np.round(rng.uniform(0, 0.1, 1500), 2),
        "heavy tail": np.exp(rng.normal(0, 4, 1000)),
        "mostly one value": np.where(rng.uniform(size=1200) < 0.7, 7.25, rng.normal(0, 50, 1200)),
        "integers": rng.integers(-50, 1000, 777).astype(float),
    }[kind]
    values[::17] = np.nan
    expected = pandas_numbers(pd.Series(values))
    rows = [(None if index % 34 == 0 else float(v),) for index, v in enumerate(values)]  # nulls beside NaN
    found = one(spark.createDataFrame(rows, "x double"))
    assert found.null_count == int(np.isnan(values).sum())
    for key in ("mean", "median", "std", "min", "max", "skewness", "kurtosis"):
        assert getattr(found, key) == pytest.approx(expected[key], rel=1e-9, abs=1e-9), key
    assert found.quantiles["p25"] == pytest.approx(expected["p25"], rel=1e-12)
    assert found.quantiles["p75"] == pytest.approx(expected["p75"], rel=1e-12)
    assert found.unique_count == expected["unique"]
    assert found.histogram_counts == expected["counts"]
    assert found.histogram_bins == expected["edges"]


@pytest.mark.parametrize("constant", [5.0, 0.0, -4.0, 0.1])
def test_constant(spark, constant):
    found = one(spark.createDataFrame([(constant,)] * 7, "x double"))
    expected = pandas_numbers(pd.Series([constant] * 7))
    assert found.is_constant
    assert (found.std, found.skewness, found.kurtosis) == (0.0, 0.0, 0.0)
    assert found.histogram_bins == expected["edges"] and found.histogram_counts == expected["counts"]


@pytest.mark.parametrize("rows", [1, 2, 3, 4])
def test_short_columns(spark, rows):
    values = [float(v) for v in (3, 8, 1, 20)[:rows]]
    found, series = one(spark.createDataFrame([(v,) for v in values], "x double")), pd.Series(values)
    assert found.std == (pytest.approx(series.std()) if rows > 1 else 0.0)
    assert found.skewness == (pytest.approx(series.skew()) if rows > 2 else 0.0)
    assert found.kurtosis == (pytest.approx(series.kurt()) if rows > 3 else 0.0)


def test_empty_and_all_null(spark):
    for rows in ([], [(None, None)] * 3):
        number, text = profile_columns(spark.createDataFrame(rows, "x double, s string"))
        assert number.mean is None and number.histogram_bins == [] and number.quantiles == {}
        assert number.is_constant and number.unique_count == 0
        assert text.mode is None
        assert number.null_percentage == (100.0 if rows else 0.0)
    assert profile_table(spark.createDataFrame([], "x double")).count() == 1


def test_infinite_values_have_no_histogram(spark):
    found = one(spark.createDataFrame([(1.0,), (2.0,), (math.inf,)], "x double"))
    assert found.histogram_bins == [] and found.histogram_counts == []
    assert found.max == math.inf and found.median == 2.0


def test_modes(spark):
    df = spark.createDataFrame(
        [("b", True, 1), ("a", True, 2), ("b", False, 3), ("a", None, 4)], "s string, b boolean, n int"
    )
    text, flag, number = profile_columns(df)
    assert text.mode == "a"  # tied with b
    assert flag.mode == "True" and flag.mean is None
    assert number.mode is None
    days = spark.sql("SELECT explode(array(DATE '2024-05-01', DATE '2024-05-01', DATE '2023-01-01')) AS d")
    assert one(days).mode == "2024-05-01"


def test_nested_decimal_and_named_columns(spark):
    df = spark.createDataFrame(
        [([1, 2], {"a": 1, "b": 2}, Decimal("1.50"), 1), ([1, 2], {"b": 2, "a": 1}, Decimal("2.50"), 2)],
        "list array<int>, map map<string,int>, price decimal(10,2), `odd.name x` int",
    )
    lists, maps, price, odd = profile_columns(df)
    assert (lists.unique_count, lists.dtype, lists.mode) == (1, "unknown", "[1,2]")
    assert maps.unique_count == 1
    assert (price.dtype, price.mean, price.unique_count) == ("float", 2.0, 2)
    assert odd.mean == 1.5


def test_approximate_distinct(spark):
    df = spark.range(5000).selectExpr("id", "id % 10 AS few")
    ids, few = profile_columns(df, distinct="approx")
    assert abs(ids.unique_count - 5000) < 300 and few.unique_count == 10
    with pytest.raises(DataAccessError):
        profile_columns(df, distinct="guess")


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0, "x", 1, None, 3, 1), (2, 2, 2.0, "y", 2, None, 2, 2), (3, 3, 3.0, "z", 4, None, 1, None)],
        "a bigint, b bigint, as_double double, s string, almost bigint, empty bigint, reversed bigint, gap bigint",
    ).selectExpr("*", "b AS c", "CAST(NULL AS bigint) AS empty2")
    found = duplicate_of(df)
    assert (found["a"], found["b"], found["c"]) == ("b", "a", "a")
    assert (found["empty"], found["empty2"]) == ("empty2", "empty")
    assert {found[name] for name in ("as_double", "s", "almost", "reversed", "gap")} == {None}


def test_duplicates_when_fingerprints_collide(spark, monkeypatch):
    from featurespark.operators import duplicates

    monkeypatch.setattr(duplicates, "_fingerprints", lambda df, columns: {name: 0 for name in columns})
    df = spark.createDataFrame([(1, 2, 1, 2, 9), (3, 4, 3, 4, 9)], "a int, b int, c int, d int, e int")
    assert duplicate_of(df) == {"a": "c", "b": "d", "c": "a", "d": "b", "e": None}


def test_profile_marks_duplicates(spark):
    df = spark.createDataFrame([(1.0, 1.0, -0.0), (0.0, -0.0, 0.0)], "x double, y double, z double")
    assert [p.is_duplicate_of for p in profile_columns(df)] == ["y", "x", None]


def test_edges_that_coincide_are_dropped():
    edges = equal_width_edges(1.0, math.nextafter(1.0, 2.0), 10)
    assert edges == sorted(set(edges)) and len(edges) < 11
    with pytest.raises(DataAccessError):
        equal_width_edges(0.0, 1.0, 0)


def test_shape_far_from_zero(spark):
    """Moments keep their precision where the sum of the values has lost it."""
    df = spark.createDataFrame([(1e16 + 2 * (i % 3),) for i in range(3000)], "x double").repartition(3)
    found = profile_columns(df)[0]
    assert abs(found.skewness) < 1e-3 and abs(found.kurtosis + 1.5) < 1e-2 and abs(found.std - 1.633) < 1e-2


def test_both_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "x double")
    found = profile_columns(df)[0]
    assert math.isnan(found.mean) and math.isnan(found.std) and math.isnan(found.skewness)
    assert (found.min, found.max, found.median) == (-math.inf, math.inf, 1.0)
    assert found.histogram_bins == found.histogram_counts == []


def test_modes_and_counts_of_long_texts(spark, monkeypatch):
    """Texts of all lengths around those that are counted by digest, ties among long ones, common beginnings."""
    rng = np.random.default_rng(4)
    start = "the same sixteen characters and more "
    columns = {
        "unique": [f"{start}{i}" for i in rng.permutation(400)],
        "tied": [f"{start}{'éx'[i % 2]}{i % 150}" for i in range(300)] + [None] * 100,
        "short": [f"é{'y' * (i % 12)}" for i in range(400)],
        "mixed": [("z" * (i % 33)) for i in range(400)],
        "hot": [start * 3 if i % 3 else f"{start}{i}" for i in range(400)],
        "one": ["x" * 16] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(5)
    for few in (1_000_000, 0):
        monkeypatch.setattr(value_counts, "FEW_DIGESTS", few)
        for profile in profile_columns(df):
            series = pd.Series(columns[profile.name])
            counts = series.value_counts()
            first = min((v for v, n in counts.items() if n == counts.max()), key=lambda v: v.encode())
            assert (profile.unique_count, profile.mode) == (series.nunique(), first), profile.name


def test_no_whole_text_is_shuffled(spark):
    plans = []
    df = spark.createDataFrame([("x" * 1000,), ("y" * 1000,)], "s string")
    summary = value_counts._texts_summary(df, ["s"], {"s": 0})
    plan = summary._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            plans.append(line)
    assert plans and all("text" not in line for line in plans)


def test_approximate_profile_of_texts(spark):
    rows = [(f"text number {i} of many that are all different", "often" if i % 3 else f"rare {i}", i % 7 == 0) for i in range(4000)]
    df = spark.createDataFrame([*rows, (None, None, None)], "many string, some string, flag boolean").repartition(3)
    many, some, flag = profile_columns(df, distinct="approx")
    assert abs(many.unique_count - 4000) < 200 and abs(some.unique_count - 1335) < 80 and flag.unique_count == 2
    assert some.mode == "often" and flag.mode == "False" and many.mode in {r[0] for r in rows}
    assert [p.null_count for p in (many, some, flag)] == [1, 1, 1]


@pytest.mark.parametrize("buffer", [2, 16])
def test_quartiles_when_the_sketch_is_poor(spark, monkeypatch, buffer):
    """A quartile that the sketch misplaced is found by further reads."""
    rng = np.random.default_rng(buffer)
    values = {"a": rng.normal(size=5000), "b": np.exp(rng.normal(0, 9, 5000)), "c": rng.integers(0, 3, 5000).astype(float)}
    df = spark.createDataFrame(pd.DataFrame(values)).repartition(4)
    monkeypatch.setattr(states, "BUFFER", buffer)
    monkeypatch.setattr(states, "MERGED_BUFFER", buffer)
    monkeypatch.setattr(profile, "SKETCH_ERROR", 1e-4)
    for found in profile_columns(df):
        expected = pandas_numbers(pd.Series(values[found.name]))
        assert found.median == pytest.approx(expected["median"], rel=1e-12)
        assert (found.quantiles["p25"], found.quantiles["p75"]) == pytest.approx((expected["p25"], expected["p75"]), rel=1e-12)
        assert found.histogram_counts == expected["counts"]


def test_states_merge_like_the_whole(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(1e9, 3, 4000), rng.normal(1e9 + 50, 0.1, 1000), [1e9 + 900]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(9)
    state = states.column_states(df, {"x": F.col("x")}, {})["x"]
    series = pd.Series(values - 1e9)
    assert state.average - 1e9 == pytest.approx(series.mean(), rel=1e-6)
    assert state.m2 == pytest.approx(((series - series.mean()) ** 2).sum(), rel=1e-6)
    assert state.m4 == pytest.approx(((series - series.mean()) ** 4).sum(), rel=1e-6)
    kept, weight = state.weighted()
    assert weight.sum() == len(values)
    for share in (0.1, 0.5, 0.9):
        place = (values < kept[np.searchsorted(np.cumsum(weight), share * weight.sum())]).mean()
        assert abs(place - share) < 0.02


def test_reads_of_a_profile(spark):
    df = spark.range(0, 50_000, 1, 3).selectExpr("id", "id % 7 AS few", "rand(1) AS r", "cast(id % 10 AS string) AS s")
    tracker, group = spark.sparkContext.statusTracker(), "profile"
    spark.sparkContext.setJobGroup(group, "")
    profile_columns(df)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Each read is a job for its tasks and one for every exchange after them.
    assert len(tracker.getJobIdsForGroup(group)) <= 9


def test_whole_numbers_that_one_double_stands_for(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(5)] + [(2**60,)], "n bigint")
    found = one(df)
    assert found.unique_count == 5 and found.min == float(2**60)
    exact = spark.sql("SELECT explode(array(1.000000000000000001BD, 1.000000000000000002BD)) AS d")
    assert one(exact).unique_count == 2
