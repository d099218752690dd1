from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from featurespark.errors import DataAccessError
from featurespark.operators import gram, ranks
from featurespark.operators.correlation import correlate, correlation_table, high_correlations


def frames(spark, with_gaps=True):
    rng = np.random.default_rng(11)
    n = 600
    data = pd.DataFrame({"a": rng.normal(size=n), "n": rng.integers(0, 5, n).astype(float)})
    data["b"] = data["a"] * 2 + rng.normal(size=n) * 0.3
    data["hot"] = np.where(rng.uniform(size=n) < 0.5, 1.0, rng.normal(size=n))
    data["same"] = 0.1
    if with_gaps:
        data["gaps"] = np.where(rng.uniform(size=n) < 0.2, np.nan, -data["b"])
    return data, spark.createDataFrame(data).repartition(3)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_equals_pandas(spark, method):
    data, df = frames(spark)
    found = correlate(df, method)
    expected = data.corr(method=method).fillna(0.0).round(6)
    assert found.columns == list(expected.columns)
    np.testing.assert_allclose(np.array(found.matrix), expected.values, atol=1.1e-6)
    high = {(a, b) for a, b, _ in found.high_correlation_pairs}
    assert ("a", "b") in high and ("a", "gaps") in high and ("a", "n") not in high


def wide(spark, parts=7):
    """Columns of few values, of one hot value, with gaps of their own, shared gaps, and one empty row."""
    rng = np.random.default_rng(3)
    n = 900
    data = pd.DataFrame({"few": rng.integers(0, 4, n), "all": rng.normal(size=n), "day": np.arange(n)}).astype(float)
    data["hot"] = np.where(rng.uniform(size=n) < 0.6, 2.5, rng.normal(size=n))
    for name in ("g1", "g2", "g3"):
        data[name] = np.where(rng.uniform(size=n) < 0.3, np.nan, data["few"] + rng.integers(0, 6, n))
    data["as_g1"] = np.where(data["g1"].isna(), np.nan, -data["day"] % 7)
    data["rare"] = np.where(rng.uniform(size=n) < 0.98, np.nan, data["all"])
    data["zero"] = np.where(data["rare"].isna(), 1.0, -0.0)
    data.loc[5] = np.nan
    rows = [tuple(None if x != x and i % 2 else x for x in row) for i, row in enumerate(data.itertuples(index=False))]
    return data, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(parts)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize(("batch", "partitions", "tile"), [(10_000, 2, 16), (7, 9, 4), (64, 40, 1)])
def test_gaps_batches_and_partitions(spark, monkeypatch, method, batch, partitions, tile):
    """Sums go on over batches; equal values that lie in several partitions have one rank; tiles make one matrix."""
    data, df = wide(spark)
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "SALTS", 2)
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": str(partitions)}
    before = {key: spark.conf.get(key) for key in settings}
    settings["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = correlate(df, method)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    np.testing.assert_allclose(np.array(found.matrix), data.corr(method=method).fillna(0.0).values, atol=1.1e-6)


def test_average_ranks(spark):
    """Less its mean, each value's rank is what pandas gives, and more so where a condition leaves rows out."""
    data, df = wide(spark)
    names = list(data)
    values = ranks.sorted_values(df, names)
    found, condition, _ = ranks.centred_ranks(values, len(names))
    assert condition[names.index("g1")] == condition[names.index("as_g1")] != condition[names.index("g2")]
    assert condition[names.index("few")] == condition[names.index("hot")] == 0
    held = {(r["row"], r["column"]): np.frombuffer(r["ranks"], "<f8") for r in found.collect()}
    assert len(held) == int(data.notna().sum().sum())
    numbers = values.join(found, ["row", "column"]).select("column", "value", "ranks").collect()
    for column, other in (("few", None), ("hot", "g1"), ("g2", "g3"), ("rare", "g2")):
        kept = data[column][data[other].notna()] if other else data[column]
        ranked = kept.rank() - (kept.notna().sum() + 1) / 2
        expected = {v: r for v, r in zip(kept, ranked) if v == v}
        k = condition[names.index(other)] if other else 0
        got = {r["value"]: x for r in numbers if names[r["column"]] == column and (x := np.frombuffer(r["ranks"], "<f8")[k])}
        assert got == {v: r for v, r in expected.items() if r}


def test_wide_tables_go_by_blocks(spark, monkeypatch):
    data, df = wide(spark)
    monkeypatch.setattr(gram, "WIDE", 5)
    found = correlate(df)
    np.testing.assert_allclose(np.array(found.matrix), data.corr().fillna(0.0).values, atol=1.1e-6)


def jobs(spark, work):
    """How many jobs run in `work`."""
    tracker, group = spark.sparkContext.statusTracker(), f"count {id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_jobs_do_not_grow_with_columns(spark, method):
    def gapped(columns):
        cells = [f"if(id % {k + 3} = 0, null, cast((id * {2 * k + 1}) % 97 as double)) as c{k}" for k in range(columns)]
        df = spark.range(0, 300, 1, 3).selectExpr(*cells)
        return jobs(spark, lambda: correlation_table(df, method).collect())

    assert gapped(4) == gapped(30) <= 12


def test_more_columns_than_one_mark_holds(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({f"c{k}": np.where(rng.uniform(size=60) < 0.1, np.nan, rng.integers(0, 9, 60)) for k in range(70)})
    found = correlate(spark.createDataFrame(data), "spearman")
    np.testing.assert_allclose(np.array(found.matrix), data.corr(method="spearman").fillna(0.0).values, atol=1.1e-6)


def test_far_from_zero_and_a_misleading_beginning(spark):
    """No sum is taken around a distant centre, wherever a task's rows lie."""
    rows = [(1e15, -1e15)] * 3 + [(1e9 + i * 1e-3, 1e9 - i * 1e-3) for i in range(500)]
    near = spark.createDataFrame(rows[3:], "a double, b double").coalesce(2)
    assert correlate(near).matrix[0][1] == -1.0
    assert correlate(spark.createDataFrame(rows, "a double, b double").coalesce(1)).matrix[0][1] == -1.0


def test_people(people):
    summary = correlate(people, high_corr_threshold=0.1)
    assert summary.columns == ["age", "income"]
    assert summary.high_correlation_pairs == [("age", "income", 0.194707)]
    assert high_correlations(people.select("age", "income"), high_corr_threshold=0.99).count() == 0


def test_pairwise_constant_is_zero(spark):
    """Column a varies, but not where b is present."""
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (7.0, None)], "a double, b double")
    assert correlate(df).matrix[0][1] == 0.0
    assert correlate(df, "spearman").matrix[0][1] == 0.0


def test_fewer_than_two_numeric_columns(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "y", False)], "n int, s string, b boolean")
    summary = correlate(df)
    assert (summary.columns, summary.matrix, summary.high_correlation_pairs) == (["n"], [], [])
    assert correlation_table(df).count() == 0


def test_infinite_empty_and_unknown_method(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (2.0, 1.0), (3.0, 2.0)], "a double, b double")
    assert correlate(df).matrix == [[1.0, 0.0], [0.0, 0.0]]
    assert correlate(spark.createDataFrame([], "a double, b double")).matrix == [[0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(DataAccessError, match="kendall"):
        correlate(df, "kendall")


def test_a_hot_value_is_ranked_in_pieces():
    """Rows of a value that fills a partition wait as numbers and marks, and leave in batches no larger than came in."""
    size, batches, width = 1_000, 200, 8
    whole = np.full(width, size * batches, np.int64)
    offsets = {(0, 0): [np.zeros(width, np.int64)] * 3}
    rank = ranks.ranker(lambda: (offsets, [(whole + 1) / 2]), list(range(-1, width - 1)))

    def partition():
        marks = np.full(size, (1 << width) - 1)
        for k in range(batches):
            lists = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32), marks)
            columns = [pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, 2.5)), pa.array(np.arange(size) + k * size)]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists, pa.array(np.zeros(size, np.int32))], ["column", "value", "row", "there", "part"]
            )

    tracemalloc.start()
    try:
        rows = 0
        for batch in rank(partition()):
            assert batch.num_rows <= size
            assert not np.frombuffer(batch.column("ranks")[0].as_py()).any()
            rows += batch.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == size * batches
    assert most < rows * 8 * width  # the ranks alone, were they made at once


def test_infinite_values_tie(spark):
    inf = float("inf")
    data = pd.DataFrame({"a": [1.0, inf, 2.0, inf, -inf, -inf, 0.5], "b": [3.0, 1.0, 2.0, 6.0, 0.0, 4.0, 5.0]})
    found = correlate(spark.createDataFrame(data).coalesce(1), "spearman")
    np.testing.assert_allclose(np.array(found.matrix), data.rank().corr().values, atol=1.1e-6)


def test_a_task_sorts_a_bounded_number_of_values(spark, monkeypatch):
    data, df = wide(spark)
    monkeypatch.setattr(ranks, "PART_VALUES", 400, raising=False)
    values = ranks.sorted_values(df, list(data))
    held = [r["count"] for r in values.groupBy("part").count().collect()]
    assert sum(held) == int(data.notna().sum().sum()) and max(held) < 3 * 400
    found = correlate(df, "spearman")
    np.testing.assert_allclose(np.array(found.matrix), data.corr(method="spearman").fillna(0.0).values, atol=1.1e-6)


def test_ranks_go_back_to_a_number_of_tasks_that_grows_with_the_rows(spark, monkeypatch):
    data, df = wide(spark)
    monkeypatch.setattr(ranks, "PART_VALUES", 100, raising=False)
    two = ["few", "g1"]
    plan = ranks.rank_correlations(df, two)._jdf.queryExecution().toString()
    parts = -(-int(data[two].notna().sum().sum()) // 100)
    assert re.search(rf"hashpartitioning\(row#\d+L, {parts}\)", plan)
