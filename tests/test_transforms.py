from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError
from featurespark.operators.transforms import (
    Fitted,
    Transformation,
    apply_fitted,
    fit_steps,
    get_transformation,
    list_transformations,
    cased_name,
    one_hot_positions,
    one_hot_vectors,
    plain_name,
    register,
    transform,
)


def column(df, name):
    return [row[name] for row in df.select(name).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (float("nan"), "b")], "x double, s string")


def test_registry():
    assert list_transformations()[:2] == ["binning", "date_features"]
    assert set(list_transformations()) >= {
        "fill_missing", "log_transform", "ratio", "standard_scale", "one_hot_encode", "binning", "date_features",
    }
    with pytest.raises(DataAccessError, match="does_not_exist.*binning"):
        get_transformation("does_not_exist")


@pytest.mark.parametrize(
    "params, expected",
    [({}, 2.0), ({"strategy": "mean"}, 2.0), ({"strategy": "mode"}, 1.0), ({"strategy": "constant", "value": 9}, 9.0)],
)
def test_fill_numbers(gaps, params, expected):
    assert column(transform(gaps, "fill_missing", {"column": "x", **params}), "x") == [1.0, expected, 3.0, expected]


def test_fill_text(gaps):
    mode = transform(gaps, "fill_missing", {"column": "s", "strategy": "mode"})
    assert column(mode, "s") == ["b", "a", "b", "b"]
    constant = transform(gaps, "fill_missing", {"column": "s", "strategy": "constant", "value": 0})
    assert column(constant, "s") == ["b", "a", "0", "b"]


def test_fill_integers_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, None)], "n int, e double")
    assert column(transform(df, "fill_missing", {"column": "n"}), "n") == [1.0, 2.0, 1.5]
    assert column(transform(df, "fill_missing", {"column": "n", "strategy": "mode"}), "n") == [1, 2, 1]
    assert column(transform(df, "fill_missing", {"column": "e"}), "e") == [None] * 3
    assert column(transform(df, "fill_missing", {"column": "e", "strategy": "mode"}), "e") == [0.0] * 3


def test_fill_dates_and_flags_by_mode(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-02 03:04:05', true), (NULL, NULL) AS t(d, b)")
    both = transform(transform(df, "fill_missing", {"column": "d", "strategy": "mode"}),
                     "fill_missing", {"column": "b", "strategy": "mode"})
    assert column(both, "d") == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 2 and column(both, "b") == [True, True]


@pytest.mark.parametrize(
    "params",
    [
        {"column": "x", "strategy": "guess"},
        {"column": "s", "strategy": "median"},
        {"column": "x", "strategy": "constant", "value": "text"},
        {"column": "nowhere"},
        {},
    ],
)
def test_bad_fills(gaps, params):
    with pytest.raises(DataAccessError):
        transform(gaps, "fill_missing", params)


def test_log(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (-5,), (None,)], "x int")
    assert column(transform(df, "log_transform", {"column": "x"}), "x_log") == pytest.approx(
        [0.0, math.log(2), math.log(11), 0.0, None]
    )
    assert "other" in transform(df, "log_transform", {"column": "x", "new_column": "other"}).columns
    with pytest.raises(DataAccessError):
        transform(spark.createDataFrame([("x",)], "x string"), "log_transform", {"column": "x"})


def test_ratio(spark):
    df = spark.createDataFrame([(10, 2.0), (20, 4.0), (5, 0.0), (5, -0.0), (None, 1.0)], "a int, b double")
    found = transform(df, "ratio", {"numerator": "a", "denominator": "b"})
    assert column(found, "a_over_b") == [5.0, 5.0, None, None, None]


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (4.0, 0.1), (None, 0.1)], "x double, c double")
    series = pd.Series([1.0, 2.0, 4.0])
    expected = ((series - series.mean()) / series.std()).tolist() + [None]
    assert column(transform(df, "standard_scale", {"column": "x"}), "x_scaled") == pytest.approx(expected)
    assert column(transform(df, "standard_scale", {"column": "c"}), "c_scaled") == pytest.approx([0.0] * 4, abs=1e-15)
    assert column(transform(df.limit(1), "standard_scale", {"column": "x"}), "x_scaled") == [None]


def test_one_hot(spark):
    df = spark.createDataFrame([("b", 1.0, True), ("a", 2.5, None), (None, None, False)], "s string, n double, f boolean")
    texts = transform(df, "one_hot_encode", {"column": "s"})
    assert texts.columns == ["s", "n", "f", "s_a", "s_b"]
    assert column(texts, "s_a") == [False, True, False]
    assert transform(df, "one_hot_encode", {"column": "n"}).columns[3:] == ["n_1.0", "n_2.5"]
    assert transform(df, "one_hot_encode", {"column": "f"}).columns[3:] == ["f_False", "f_True"]
    with pytest.raises(DataAccessError, match="more than 1 distinct"):
        transform(df, "one_hot_encode", {"column": "s", "max_values": 1})
    with pytest.raises(DataAccessError, match="exists already"):
        transform(texts, "one_hot_encode", {"column": "s"})


@pytest.mark.parametrize("bins", [1, 5, 10, 37, [0, 10, 10, 50, 100.5], [-1000, 1000], [3, 3], [500, 600]])
@pytest.mark.parametrize("kind", ["spread", "rounded", "constant"])
def test_bins_equal_pandas(spark, bins, kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.normal(30, 40, 300),
        "rounded": np.round(rng.uniform(0, 0.1, 300), 2),
        "constant": np.full(10, -4.0),
    }[kind]
    values[3] = np.nan
    expected = pd.cut(pd.Series(values), bins=bins, labels=False, duplicates="drop")
    df = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1)
    found = column(transform(df, "binning", {"column": "x", "bins": bins}), "x_bin")
    assert found == [None if math.isnan(v) else int(v) for v in expected]


def test_bins_that_cannot_be_made(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.inf, "b")], "x double, s string")
    for table, params in (
        (df, {"column": "x"}),
        (df.limit(0), {"column": "x"}),
        (df, {"column": "s"}),
        (df, {"column": "x", "bins": 0}),
        (df, {"column": "x", "bins": "many"}),
        (df, {"column": "x", "bins": [3, 1]}),
    ):
        with pytest.raises(DataAccessError):
            transform(table, "binning", params)
    empty = spark.createDataFrame([(None,)], "x double")
    assert column(transform(empty, "binning", {"column": "x"}), "x_bin") == [None]


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-02-03", dt.date(2024, 2, 4)), ("2024-02-05 10:00:00", None), ("junk", dt.date(1999, 12, 31)),
         ("2024/02/03", None), (None, None)], "t string, d date",
    )
    found = transform(transform(df, "date_features", {"column": "t"}), "date_features", {"column": "d"})
    assert column(found, "t_year") == [2024, 2024, None, None, None]
    assert column(found, "t_dayofweek") == [5, 0, None, None, None]
    assert column(found, "d_month") == [2, None, 12, None, None]
    assert column(found, "d_dayofweek") == [6, None, 4, None, None]
    slashes = transform(df, "date_features", {"column": "t", "format": "yyyy/MM/dd"})
    assert column(slashes, "t_month") == [None, None, None, 2, None]
    with pytest.raises(DataAccessError):
        transform(spark.range(1), "date_features", {"column": "id"})


def test_fitted_steps_are_stored_and_applied_to_new_data(spark):
    train = spark.createDataFrame([(float(v), "ab"[v % 2]) for v in range(10)], "x double, s string")
    steps = [("standard_scale", {"column": "x"}), ("binning", {"column": "x", "bins": 3}),
             ("one_hot_encode", {"column": "s"}), ("fill_missing", {"column": "x"})]
    fitted = fit_steps(train, [(get_transformation(name), name, params) for name, params in steps])
    restored = [Fitted.from_json(step.to_json()) for step in fitted]
    assert restored == fitted
    new = spark.createDataFrame([(4.5, "c"), (None, "a"), (99.0, "b")], "x double, s string")
    rows = apply_fitted(new, *restored).collect()
    assert [row["x_scaled"] for row in rows][0] == 0.0
    assert [row["x_bin"] for row in rows] == [1, None, None]
    assert [(row["s_a"], row["s_b"]) for row in rows] == [(False, False), (True, False), (False, True)]
    assert [row["x"] for row in rows] == [4.5, 4.5, 99.0]


def test_registering_functions_and_classes(spark):
    @register("test_double")
    def double(df, params):
        return df.withColumn(params["column"] + "_double", F.col(params["column"]) * 2)

    @register("test_shift")
    class Shift(Transformation):
        def columns(self, schema, params, state):
            return {f"{params['column']}_shifted": F.col(params["column"]) + params["by"]}

    df = spark.range(2)
    assert column(transform(df, "test_double", {"column": "id"}), "id_double") == [0, 2]
    assert column(transform(df, "test_shift", {"column": "id", "by": 5}), "id_shifted") == [5, 6]


def test_apply_is_a_projection(spark):
    """No shuffle and no UDF: fitted steps can be applied to any amount of data in one pass."""
    df = spark.range(100).selectExpr("cast(id as double) x", "cast(id % 3 as string) s")
    out = transform(transform(df, "binning", {"column": "x"}), "one_hot_encode", {"column": "s"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan


def test_one_hot_of_values_that_differ_by_case(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), ("YES",), ("no",), ("^No",), (None,)], "s string").coalesce(1)
    out = transform(df, "one_hot_encode", {"column": "s"})
    assert out.columns == ["s", "s_^Y^E^S", "s_^Yes", "s_^No", "s_no", "s_yes"]
    ones = [[c for c in out.columns[1:] if r[c]] for r in out.collect()]
    assert ones == [["s_^Yes"], ["s_yes"], ["s_^Y^E^S"], ["s_no"], ["s_^No"], []]
    taken = transform(df.withColumn("s_yes", F.lit(1)).where("s = 'Yes'"), "one_hot_encode", {"column": "s"})
    assert taken.columns == ["s", "s_yes", "s_^Yes"]
    for text in ("Yes", "yes", "^", "a^B", "İß", "^^A"):
        assert plain_name(cased_name(text)) == text
    assert len({cased_name(x).lower() for x in ("Yes", "yes", "YES", "^Yes", "^yes")}) == 5


def test_one_hot_on_tables_with_any_column_names(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4), ("b", 5, 6, 7, 8), (None, 0, 0, 0, 0)], "_value string, _at int, _hot int, value int, position int")
    found = {r["_value"]: r for r in one_hot_positions(df, "_value").collect()}
    assert {k: r["_value_position"] for k, r in found.items()} == {"a": 0, "b": 1, None: None}
    assert tuple(found["b"])[:5] == ("b", 5, 6, 7, 8)
    vectors = {r["_value"]: r["_value_vector"] for r in one_hot_vectors(df, "_value").collect()}
    assert {k: tuple(v) for k, v in vectors.items()} == {"a": (2, [0], [1.0]), "b": (2, [1], [1.0]), None: (2, [], [])}


def test_one_hot_of_many_values(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"v{i % 700:04}") for i in range(4000)], "k int, v string")
    assert len(transform(df, "one_hot_encode", {"column": "k"}).columns) == 4002
    values = sorted({r.v for r in df.collect() if r.v})
    found = {r.k: r.v_position for r in one_hot_positions(df.repartition(4), "v").collect()}
    assert found == {r.k: values.index(r.v) if r.v else None for r in df.collect()}


@pytest.mark.parametrize(("form", "texts"), [("%m/%d/%Y", ["01/31/2024", "12/25/1999"]), ("%d.%m.%Y", ["31.01.2024", "25.12.1999"])])
def test_dates_in_other_forms(spark, form, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "junk", None]], "d string")
    found = [(r.d_year, r.d_month) for r in transform(df, "date_features", {"column": "d"}).collect()]
    assert found == [(2024, 1), (1999, 12), (None, None), (None, None)]


def test_bad_constants_and_names_fail_at_once(spark):
    df = spark.createDataFrame([(None, "Yes"), (None, "yes")], "d date, INCOME string")
    for name, params in (
        ("fill_missing", {"column": "d", "strategy": "constant"}), ("one_hot_encode", {"column": "INCOME", "max_values": 1}),
        ("date_features", {"column": "INCOME", "format": "no {such} format"}),
    ):
        with pytest.raises(DataAccessError):
            transform(df, name, params)
