from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurespark.errors import DataAccessError
from featurespark.operators import budget as module
from featurespark.operators.budget import budget_select, budget_summary

SCHEMA = "g string, pos int, urgency int, text string"


def greedy(rows, budget):
    """Reference by hand: in order of urgency and position, keep what still fits."""
    result = {}
    for group in {row[0] for row in rows}:
        used, kept, truncated = 0, [], False
        for _, pos, urgency, text in sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1])):
            cost = max(1, len(text) // 4)
            if used + cost > budget:
                truncated = True
            else:
                used, kept = used + cost, [*kept, pos]
        result[group] = (sorted(kept), used, truncated)
    return result


def check(spark, rows, budget, reserved=5):
    df = spark.createDataFrame(rows, SCHEMA)
    arguments = ("g", "pos", "text", "urgency", budget + reserved, reserved)
    expected = greedy(rows, budget)
    totals = {r["g"]: r for r in budget_summary(df, *arguments).collect()}
    kept = {}
    for row in budget_select(df, *arguments).collect():
        kept.setdefault(row["g"], []).append(row["pos"])
    for group, (positions, used, truncated) in expected.items():
        assert sorted(kept.get(group, [])) == positions
        assert (totals[group]["estimated_tokens"], totals[group]["truncated"]) == (used, truncated)
        assert totals[group]["kept_rows"] == len(positions)
    assert set(totals) == set(expected)


def made(seed, count, longest, groups="abc"):
    rng = random.Random(seed)
    return [
        (rng.choice(groups), pos, rng.randrange(3), "é" * rng.randrange(longest)) for pos in range(count)
    ]


@pytest.mark.parametrize("budget", [0, 1, 7, 40, 10_000])
def test_against_brute_force(spark, budget):
    check(spark, made(budget, 300, 60), budget)


@pytest.mark.parametrize("spread", [1, 2, 4096])
def test_one_large_group_of_few_costs(spark, monkeypatch, spread):
    monkeypatch.setattr(module, "SPREAD", spread)
    check(spark, made(3, 2000, 9, "a") + [("b", 1, 0, "x" * 400)], 25)


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.integers(0, 50)), min_size=1, max_size=25),
    st.integers(0, 30),
)
def test_any_rows(spark, items, budget):
    check(spark, [(g, pos, urgency, "x" * size) for pos, (g, urgency, size) in enumerate(items)], budget)


def test_bounded_groups(spark):
    """What comes together per group is bounded by the budget, not by the number of rows."""
    df = spark.range(20_000).selectExpr("'a' AS g", "cast(id AS int) pos", "0 AS urgency", "repeat('x', 40) AS text")
    row = budget_summary(df, "g", "pos", "text", "urgency", 105, 5).first()
    assert (row["kept_rows"], row["estimated_tokens"], row["truncated"]) == (10, 100, True)
    plan = budget_summary(df, "g", "pos", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and plan.index("collect_list") < plan.index("Window")


def test_missing_text_and_bad_budget(spark):
    df = spark.createDataFrame([("a", 1, 0, None), ("a", 2, 0, "")], SCHEMA)
    assert budget_summary(df, "g", "pos", "text", None, 2, 0).first()["estimated_tokens"] == 2
    with pytest.raises(DataAccessError):
        budget_summary(df, "g", "pos", "text", None, 10, 11)


def test_null_groups_and_positions_are_kept(spark):
    rows = [(None, 1, "a" * 40), (None, 2, "b" * 4000), ("g", None, "c" * 40), ("g", 2, "d" * 40)]
    df = spark.createDataFrame(rows, "grp string, place int, text string")
    kept = budget_select(df, "grp", "place", "text", None, 100, 0).collect()
    assert {(r.grp, r.place) for r in kept} == {(None, 1), ("g", None), ("g", 2)}
