from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from featurespark import Proposal, TableHandle, read_plan, register, run_plan
from featurespark.errors import DataAccessError
from featurespark.plans import plan as module
from featurespark.plans.plan import approved_names, parse_plan, run_summary
from featurespark.plans.report import pair_lines, profile_lines, report, report_sections
from featurespark.operators.profile import profile_table

AGES_STEP = {
    "name": "age_groups", "operation": "binning", "source_columns": ["age"],
    "rationale": "four groups are enough", "risk_level": "medium", "params": {"column": "age", "bins": 4},
}


def parsed(spark, text):
    return parse_plan(spark.createDataFrame([(text,)], "value string"))


@pytest.fixture
def numbers(people):
    return TableHandle(people.select("age", "income").fillna(0))


def test_plan_texts(spark):
    assert parsed(spark, json.dumps([AGES_STEP])) == [
        Proposal("age_groups", "binning", ["age"], AGES_STEP["rationale"], "medium", {"column": "age", "bins": 4})
    ]
    assert parsed(spark, f"```json\n{json.dumps([AGES_STEP])}\n```") == parsed(spark, json.dumps([AGES_STEP]))
    for text in ("not json", "", "{}", json.dumps({"a": 1}), "[]"):
        assert parsed(spark, text) == []
    incomplete = [{key: value for key, value in AGES_STEP.items() if key != missing} for missing in AGES_STEP]
    assert len(parsed(spark, json.dumps([*incomplete, AGES_STEP]))) == 3  # risk_level and params may be left out
    binned = {**AGES_STEP, "params": {"column": "income", "bins": [0, 1.5, 3], "new_column": "5"}}
    assert parsed(spark, json.dumps([binned]))[0].params == {"column": "income", "bins": [0, 1.5, 3], "new_column": "5"}


def test_plan_file(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps([AGES_STEP], indent=1))
    assert [proposal.name for proposal in read_plan(spark, str(tmp_path / "plan.json"))] == ["age_groups"]


def test_decisions():
    proposals = [Proposal("a", "ratio"), Proposal("b", "ratio")]
    assert approved_names(proposals, "approve") == ["a", "b"]
    assert approved_names(proposals, "modify", ["b"]) == ["b"]
    assert [approved_names(proposals, kind) for kind in ("skip", "reject", "cancel", "rollback")] == [[]] * 4
    assert approved_names(proposals) == []
    with pytest.raises(DataAccessError):
        approved_names(proposals, "maybe")


def test_approved_plan_runs(spark, numbers):
    run = run_plan(numbers, parsed(spark, json.dumps([AGES_STEP])), "age_groups")
    assert (run.executed, run.version_before, run.version_after) == (["age_groups"], 0, 1)
    assert run.log == ["Executed 'age_groups' via binning"]
    assert run_summary(run) == "Executed 1 feature(s): age_groups. Dataset moved from version 0 to 1."
    assert run.log_table(spark).first()["status"] == "executed"


def test_rejected_plan_changes_nothing(spark, numbers):
    run = run_plan(numbers, parsed(spark, json.dumps([AGES_STEP])))
    assert run.steps == [] and numbers.version == 0
    assert run_summary(run) == "Executed 0 feature(s): none. Dataset moved from version 0 to 0."
    assert run_summary(None) == "No transformations were executed this round."


def steps(*items):
    return [Proposal(f"s{index}", operation, params=params) for index, (operation, params) in enumerate(items)]


def test_failures_are_logged_and_the_rest_runs(numbers):
    plan = steps(
        ("log_transform", {"column": "income"}), ("no_such", {}), ("standard_scale", {"column": "income_log"}),
        ("binning", {"column": "income", "bins": 0}), ("one_hot_encode", {"column": "age", "max_values": 2}),
        ("ratio", {"numerator": "income", "denominator": "age"}),
    )
    run = run_plan(numbers, plan, 'all')
    assert run.executed == ["s0", "s2", "s5"]
    assert [step.version_after for step in run.steps] == [1, 1, 2, 2, 2, 3]
    assert run.log[1].startswith("Failed 's1': Unknown transformation 'no_such'")
    assert numbers.df.columns == ["age", "income", "income_log", "income_log_scaled", "income_over_age"]


def test_shared_fits_equal_single_steps(people, monkeypatch):
    plan = steps(
        ("fill_missing", {"column": "age"}), ("standard_scale", {"column": "income"}),
        ("binning", {"column": "income", "bins": 4}), ("standard_scale", {"column": "age"}),
        ("ratio", {"numerator": "age", "denominator": "income_scaled"}), ("one_hot_encode", {"column": "category"}),
        ("fill_missing", {"column": "category", "strategy": "mode"}),
    )
    batches = []
    original = module.fit_steps
    monkeypatch.setattr(module, "fit_steps", lambda df, part: (batches.append(len(part)), original(df, part))[1])
    together, single = TableHandle(people), TableHandle(people)
    run_plan(together, plan, 'all')
    for proposal in plan:
        single.apply(proposal.operation, proposal.params)
    assert batches == [3, 2]  # then the encoding and the last step alone
    assert together.version == single.version == len(plan)
    assert together.df.columns == single.df.columns
    assert sorted(map(str, together.df.collect())) == sorted(map(str, single.df.collect()))


def test_items_are_judged_one_by_one(spark):
    text = json.dumps([AGES_STEP, 5, {**AGES_STEP, "name": "listed", "params": [1]}, {**AGES_STEP, "name": "typed",
                       "params": {"value": "true", "bins": "1e3", "empty": "null", "flag": True, "n": 3}}])
    found = {p.name: p.params for p in parsed(spark, text)}
    assert set(found) == {"age_groups", "typed"}
    assert found["typed"] == {"value": "true", "bins": "1e3", "empty": "null", "flag": True, "n": 3}


def test_failures_on_the_data_are_logged_where_they_happen(numbers):
    @register("test_failing", reads=["column"])
    def failing(df, params):
        return df.selectExpr("*", "raise_error('late') AS broken")

    plan = steps(("test_failing", {"column": "age"}), ("log_transform", {"column": "income"}))
    run = run_plan(numbers, plan, "all", validate=True)
    assert run.executed == ["s1"] and "late" in run.log[0] and numbers.df.count() == 12


def test_clashing_outputs_are_refused_like_single_steps(people):
    plan = steps(
        ("log_transform", {"column": "income", "new_column": "category_north"}), ("one_hot_encode", {"column": "category"}),
        ("log_transform", {"column": "age", "new_column": "INCOME"}),
        ("fill_missing", {"column": "category", "strategy": "constant", "value": "x"}),
    )
    table = TableHandle(people)
    assert run_plan(table, plan, "all").executed == ["s0", "s3"]


def test_guard_of_plans(people):
    plan = steps(("one_hot_encode", {"column": "email"}), ("log_transform", {"column": "income"}))
    guarded = TableHandle(people)
    assert run_plan(guarded, plan, 'all').executed == ["s1"]
    assert run_plan(TableHandle(people), plan, 'all', guard=False).executed == ["s0", "s1"]


def test_registered_function_in_a_plan(numbers):
    @register("test_twice")
    def twice(df, params):
        return df.withColumn("twice", df[params["column"]] * 2)

    run = run_plan(numbers, steps(("test_twice", {"column": "age"}), ("log_transform", {"column": "twice"})), "all")
    assert run.executed == ["s0", "s1"] and numbers.df.columns[-1] == "twice_log"


def test_report_lines(spark, people):
    lines = {row["name"]: row["line"] for row in profile_lines(profile_table(people)).collect()}
    assert lines["age"].startswith("age: dtype=float, nulls=8.3333%, unique=11, mean=41.27272727")
    assert lines["income"].startswith("income: dtype=integer, nulls=0.0%, unique=12, mean=47231.8333")
    assert lines["email"] == "email: dtype=string, nulls=0.0%, unique=12, mean=None"
    pairs = spark.createDataFrame([("a", "b", 0.125), ("a", "c", -0.865)], "col_a string, col_b string, corr double")
    assert [row["line"] for row in pair_lines(pairs).collect()] == ["a~b=0.12", "a~c=-0.86"]


def test_report_within_a_budget(people):
    table = TableHandle(people)
    sections = report_sections(table, ["keep age"], "Nothing yet.", [f"step {n}" for n in range(7)], "Plan!")
    text, tokens, truncated = report(sections)
    assert text.startswith("Visible columns: age, income, category\n\nDataset: 12 rows, 5 cols, version 0\n\n")
    assert "User constraints: keep age\n\nPlan!\n\nColumn profiles:\nage: " in text
    assert text.endswith("Recent execution history: step 2; step 3; step 4; step 5; step 6")
    assert not truncated and "email" not in text
    short, used, cut = report(sections, 60, 20)
    assert cut and used <= 40 and "Column profiles" not in short and "Plan!" in short


def test_validation_computes_all_steps_in_one_read(spark, people):
    counter = spark.sparkContext.accumulator(0)

    def counted(x):
        counter.add(1)
        return x

    seen = F.udf(counted, "double")
    df = people.select("age", "income").coalesce(1).withColumn("income", seen(F.col("income").cast("double")))
    plan = steps(*[("log_transform", {"column": "income", "new_column": f"log{k}"}) for k in range(5)], ("ratio", {"numerator": "income", "denominator": "age"}))
    table = TableHandle(df)
    run = run_plan(table, plan, "all", guard=False, validate=True)
    assert len(run.executed) == 6 and table.version == 6
    # One row is read for each of the 12; the projections on it may ask for the value again.
    assert counter.value <= 12 * 7
    assert run.rows == 12 and list(run.missing.values()) == [0, 0, 0, 0, 0, 1]


def test_only_read_columns_are_judged(spark, people):
    table = TableHandle(people)
    run = run_plan(table, steps(("log_transform", {"column": "income"})), "all")
    assert len(run.executed) == 1
    assert set(table._versions[0].sensitive) == {"income"}
