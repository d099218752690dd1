from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError
from featurespark.operators.sensitive import PATTERN_DETECTOR, aggregate_votes, match_ratios, name_hints
from featurespark.operators.visibility import sample_table, sample_values


def judge(spark, name, values, **options):
    df = spark.createDataFrame([(value,) for value in values], f"`{name}` string")
    return aggregate_votes(df, **options).first()


@pytest.mark.parametrize(
    "name, category",
    [
        ("customer_email", "email"), ("email_address", "email"), ("hotel", "phone"), ("ip_address", "address"),
        ("mac_address", "address"), ("ip_addr", "ip_address"), ("Customer_ID", "user_id"), ("age", "none"),
        ("Surname", "name"), ("imei", "device_id"),
    ],
)
def test_names(spark, name, category):
    assert judge(spark, name, ["-"])["category"] == category


def test_names_hold_several_hints(spark):
    found = {(r["column"], r["category"]) for r in name_hints(spark, ["email_address", "x"]).collect()}
    assert found == {("email_address", "email"), ("email_address", "address")}


@pytest.mark.parametrize(
    "value, category",
    [
        ("a@example.com", "email"), (" jürgen.müller@exämple.org\n", "email"), (" x_1@b-c.de\t", "email"),
        ("+4912345678", "phone"), ("1234567", "phone"), ("٠١٢٣٤٥٦٧٨", "phone"), ("123-45-6789", "ssn"),
        ("4000 1234 5678 9012", "credit_card"), ("4000123456789", "phone"), ("4000123456789012", "credit_card"),
        ("10.0.0.255", "ip_address"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("d" * 40, "hash"),
        ("123456", "none"), ("a@b", "none"), ("text a@example.com", "none"), ("d" * 65, "none"),
    ],
)
def test_values(spark, value, category):
    row = judge(spark, "field", [value] * 3)
    assert row["category"] == category
    assert row["confidence"] == (0.95 if category != "none" else 0.0)


def test_value_needs_a_share_of_two_ninths(spark):
    assert judge(spark, "field", ["1.2.3.4"] * 2 + ["x"] * 7)["category"] == "ip_address"
    row = judge(spark, "field", ["1.2.3.4"] * 1 + ["x"] * 7)
    assert (row["category"], row["recommended_action"]) == ("none", "allow")
    assert row["confidence"] == pytest.approx(0.5 + 0.45 / 8)


def test_value_beats_name_from_four_ninths(spark):
    assert judge(spark, "user_id", ["1.2.3.4"] * 4 + ["x"] * 5)["category"] == "ip_address"
    row = judge(spark, "user_id", ["1.2.3.4"] * 3 + ["x"] * 6)
    assert (row["category"], row["confidence"], row["recommended_action"]) == ("user_id", 0.7, "summarize_only")
    assert row["explanation"] == (
        "Regex stage classified column 'user_id' as user_id based on column name heuristic (confidence=0.70)."
    )


def test_missing_values_do_not_count(spark):
    assert judge(spark, "field", ["1.2.3.4", None, None, None])["confidence"] == 0.95
    assert judge(spark, "field", [None])["category"] == "none"
    assert judge(spark, "email", [])["category"] == "email"


def test_threshold(spark):
    row = judge(spark, "email", ["a@example.com"], threshold=0.99)
    assert (row["category"], row["is_sensitive"], row["confidence"]) == ("none", False, 0.95)
    row = judge(spark, "age", ["25"], threshold=0.0)
    assert (row["category"], row["recommended_action"]) == ("none", "summarize_only")


def test_votes_of_several_detectors(spark):
    def sure(category, confidence):
        return lambda df: df.sparkSession.createDataFrame(
            [(name, category, confidence, f"{category}!") for name in df.columns],
            "column string, category string, confidence double, explanation string",
        )

    df = spark.createDataFrame([("a@example.com", "25")], "mail string, age string")
    rows = aggregate_votes(df, [PATTERN_DETECTOR, ("b", sure("hash", 0.95)), ("c", sure("uuid", 0.8))]).collect()
    assert [row["column_name"] for row in rows] == ["mail", "age"]
    assert [row["category"] for row in rows] == ["email", "hash"]  # the first of equals, then the most confident
    assert [vote["stage_name"] for vote in rows[0]["votes"]] == ["regex", "b", "c"]
    assert rows[1]["explanation"].endswith(" | hash! | uuid!")
    with pytest.raises(DataAccessError):
        aggregate_votes(df, [])


def test_only_columns_that_can_match_are_read(spark):
    df = spark.createDataFrame([(1234567, 1234567.0, True)], "n bigint, d double, b boolean")
    assert {row["column"] for row in match_ratios(df).collect()} == {"n"}
    assert aggregate_votes(df).where("is_sensitive").first()["column_name"] == "n"


def test_samples(spark):
    df = spark.range(100, 0, -1).select(
        F.col("id"), F.when(F.col("id") > 30, F.col("id") / 2).alias("late"), F.lit(None).cast("string").alias("empty")
    )
    samples = sample_values(df, order_by="id")
    assert samples["id"] == [str(n) for n in range(1, 21)]
    assert samples["late"] == [str(n / 2) for n in range(31, 51)]
    assert samples["empty"] == []
    assert sample_table(df, samples).count() == 20
    assert sample_values(df.limit(3), size=5)["empty"] == []
