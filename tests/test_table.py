from __future__ import annotations

import pytest

from featurespark import DataAccessError, PolicyViolationError, TableHandle
from featurespark.operators.transforms import CATALOGUE, register
from featurespark.operators.visibility import preview
from featurespark.sources.tables import read_version


def test_sensitive_columns_are_hidden(people):
    table = TableHandle(people)
    assert table.visible_columns() == ["age", "income", "category"]
    flags = {row["name"]: row.asDict() for row in table.schema().collect()}
    assert flags["email"]["is_pii"] and flags["customer_id"]["is_pii"] and not flags["age"]["is_pii"]
    assert flags["age"]["nullable"] and not flags["income"]["nullable"]
    assert table.visible().columns == ["age", "income", "category"]
    assert {row["name"] for row in table.profiles().collect()} == {"age", "income", "category"}
    assert table.correlation().columns == ["age", "income"]


def test_guard(people):
    table = TableHandle(people, blocked_columns=["income"])
    assert table.column_profile("age").first()["name"] == "age"
    for column in ("email", "income"):
        with pytest.raises(PolicyViolationError):
            table.column_profile(column)
        with pytest.raises(PolicyViolationError):
            table.preview(["age", column])
    with pytest.raises(DataAccessError):
        table.column_profile("nowhere")


def test_whole_columns_are_judged(spark):
    rows = [(i, "n/a" if i < 20 else f"p{i}@example.org") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, note string").coalesce(1)
    assert TableHandle(df).visible_columns() == ["k"]
    assert TableHandle(df, sample_size=20, order_by="k").visible_columns() == ["k", "note"]


def test_preview(people):
    table = TableHandle(people, preview_row_cap=3)
    rows = table.preview(["age", "income"], max_rows=100, order_by="income").collect()
    assert [tuple(row) for row in rows] == [("20.0", "40000"), ("33.0", "41527"), ("46.0", "43054")]
    assert table.preview(["age"]).count() == 3
    assert table.preview(["age"], max_rows=0).count() == 0
    assert table.preview(["age"], max_rows=-1).count() == 0
    everything = preview(people, ["age"], row_cap=50).collect()
    assert len(everything) == 12 and "" in [row["age"] for row in everything]


def test_versions(people):
    table = TableHandle(people)
    assert table.apply("log_transform", {"column": "income"}) == 1
    assert "income_log" in [row["name"] for row in table.profiles().collect()]
    meta = table.metadata().first()
    assert (meta["version"], meta["row_count"], meta["column_count"]) == (1, 12, 6)
    assert table.rollback(0) == 0
    assert "income_log" not in [row["name"] for row in table.profiles().collect()]
    assert table.list_versions() == [0, 1]
    assert table.apply("standard_scale", {"column": "income"}) == 1  # replaces the old version 1
    assert table.df.columns[-1] == "income_scaled" and table.list_versions() == [0, 1]
    with pytest.raises(DataAccessError):
        table.rollback(9)


def test_failing_transformation_keeps_the_version(people):
    table = TableHandle(people)
    for name, params in (("no_such", {}), ("log_transform", {"column": "category"}), ("ratio", {"numerator": "age"})):
        with pytest.raises(DataAccessError):
            table.apply(name, params)
    assert table.version == 0 and table.list_versions() == [0]
    with pytest.raises(PolicyViolationError):
        table.apply("one_hot_encode", {"column": "email"})


def test_only_changed_columns_are_profiled_again(people, monkeypatch):
    from featurespark.plans import table as module

    seen = []
    original = module.complete_profiles
    monkeypatch.setattr(
        module, "complete_profiles", lambda df, basics, distinct: (seen.append([p.name for p in basics]),
                                                                   original(df, basics, distinct))
    )
    table = TableHandle(people.select("age", "income"))
    table.profiles()
    table.apply("fill_missing", {"column": "age"})
    ages = {row["name"]: row["null_count"] for row in table.profiles().collect()}
    assert seen == [["age", "income"], ["age"]] and ages == {"age": 0, "income": 0}


def test_duplicates_are_found_again_after_a_step(people):
    table = TableHandle(people.select("income"))
    table.apply("fill_missing", {"column": "income", "strategy": "constant"})
    table.apply("ratio", {"numerator": "income", "denominator": "income", "new_column": "one"})
    table.apply("ratio", {"numerator": "one", "denominator": "one", "new_column": "again"})
    found = {row["name"]: row["is_duplicate_of"] for row in table.profiles().collect()}
    assert found == {"income": None, "one": "again", "again": "one"}
    assert table.column_profile("one").first()["is_duplicate_of"] == "again"


def test_snapshots(people, tmp_path):
    table = TableHandle(people.select("age", "income"), snapshot_path=str(tmp_path))
    table.apply("log_transform", {"column": "income"})
    assert len(list(tmp_path.glob(f"{table.dataset_id}/version=1-*"))) == 1
    assert table.df.inputFiles() and table.df.count() == 12


def size(folder):
    return sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())


def test_versions_cost_their_steps_only(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 2).selectExpr("id", "rand(1) AS a", "rand(2) AS b")
    table = TableHandle(rows, snapshot_path=str(tmp_path))
    for k in range(10):
        table.apply("log_transform", {"column": "a", "new_column": f"log{k}"})
    kept = tmp_path / table.dataset_id
    whole = size(next(kept.glob("version=0-*")))
    assert size(kept) < 1.2 * whole
    again = read_version(spark, str(next(kept.glob("version=10-*"))))
    assert again.columns == table.df.columns
    assert sorted(again.collect()) == sorted(table.df.collect())
    # The values don't change when the source does: they come from the snapshot.
    assert table.df.where("a <> b").count() == 20_000 and table.df.inputFiles()


def test_removed_versions(spark, people, tmp_path):
    register("shuffled_rows", reads=["column"])(lambda df, params: df.orderBy(params["column"]))
    table = TableHandle(people.select("age", "income"), snapshot_path=str(tmp_path))
    table.apply("log_transform", {"column": "income"})
    table.apply("shuffled_rows", {"column": "income"}, guard=False)
    table.apply("standard_scale", {"column": "income"})
    kept = tmp_path / table.dataset_id
    with pytest.raises(DataAccessError):
        table.remove_versions([7])
    assert table.remove_versions([2]) == [2, 3] == table.list_versions()
    assert {x.name.split("-")[0] for x in kept.iterdir()} == {"version=2", "version=3"}
    assert table.df.count() == 12 and table.rollback(2) == 2 and table.df.count() == 12
    with pytest.raises(DataAccessError):
        table.rollback(1)
    table.rollback(3)
    assert table.remove_versions([]) == [3]
    assert {x.name.split("-")[0] for x in kept.iterdir()} == {"version=2", "version=3"}  # version 3 reads the table of 2
    del CATALOGUE["shuffled_rows"]


def test_long_chains_of_steps_end_in_a_table(people, tmp_path, monkeypatch):
    monkeypatch.setattr(TableHandle, "COMPACT_AFTER", 3)
    table = TableHandle(people.select("income"), snapshot_path=str(tmp_path))
    for k in range(7):
        table.apply("log_transform", {"column": "income", "new_column": f"log{k}"})
    assert [len(table._versions[k].steps) for k in range(8)] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert len(table.df.columns) == 8 and table.df.count() == 12


def test_size_and_analysis(spark):
    df = spark.createDataFrame([("ab", 1, True), ("é", 2, None), (None, 3, False)], "s string, n bigint, b boolean")
    table = TableHandle(df)
    assert table.metadata().first()["size_bytes"] == 4 + 24 + 3
    found = table.analyze()
    assert set(found) == {"metadata", "schema", "profiles", "correlation"}
    assert found["correlation"].matrix == []


def test_empty_table(spark):
    table = TableHandle(spark.createDataFrame([], "a double, s string"))
    assert table.metadata().first()["row_count"] == 0
    assert [row["is_constant"] for row in table.profiles().collect()] == [True, True]
    assert table.preview(["a"]).count() == 0
