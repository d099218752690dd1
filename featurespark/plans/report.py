"""A table's profile as lines of text, and as one text within a token budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.functions.text import double_text
from featurespark.operators.budget import MAX_TOKENS, RESERVED_TOKENS, budget_select, budget_summary
from featurespark.plans.table import TableHandle

RECENT_STEPS = 5

# Sections of a report in order, each with its priority and text.
SECTIONS: dict[str, tuple[int, str]] = {
    "schema": (0, "Visible columns: {}"),
    "metadata": (0, "Dataset: {} rows, {} cols, version {}"),
    "constraints": (0, "User constraints: {}"),
    "profiles": (1, "Column profiles:\n{}"),
    "correlation": (1, "Highly correlated pairs: {}"),
    "summary": (2, "Prior conversation summary: {}"),
    "history": (2, "Recent execution history: {}"),
    "instruction": (0, "{}"),
}


def profile_lines(profiles: DataFrame) -> DataFrame:
    """One line per profiled column."""
    mean = F.coalesce(double_text(F.col("mean")), F.lit("None"))
    line = F.concat(
        F.col("name"), F.lit(": dtype="), F.col("dtype"),
        F.lit(", nulls="), double_text(F.col("null_percentage")), F.lit("%, unique="),
        F.col("unique_count").cast("string"), F.lit(", mean="), mean,
    )
    return profiles.select("name", line.alias("line"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """One text per correlated pair, the coefficient with two digits."""
    # format_number rounds the binary value half to even; its only group separator would need |corr| >= 1000.
    text = F.concat(F.col("col_a"), F.lit("~"), F.col("col_b"), F.lit("="), F.format_number("corr", 2))
    return pairs.select("col_a", "col_b", text.alias("line"))


def report_sections(
    table: TableHandle,
    constraints: Sequence[str] = (),
    last_summary: str = "",
    history: Sequence[str] = (),
    instruction: str = "",
) -> DataFrame:
    """Sections (priority, position, label, text) of a report on the visible part of a table."""
    spark = table.df.sparkSession
    meta = table.metadata().first()
    high = table.correlation().high_correlation_pairs
    pairs = pair_lines(spark.createDataFrame(high, "col_a string, col_b string, corr double")).collect()
    found = {
        "schema": [", ".join(table.visible_columns())],
        "metadata": [meta.row_count, meta.column_count, meta.version],
        "constraints": ["; ".join(constraints)],
        "profiles": ["\n".join(row["line"] for row in profile_lines(table.profiles()).collect())],
        "correlation": ["; ".join(row["line"] for row in pairs)],
        "summary": [last_summary],
        "history": ["; ".join(history[-RECENT_STEPS:])],
        "instruction": [instruction],
    }
    rows = []
    for position, (label, (priority, text)) in enumerate(SECTIONS.items()):
        if label == "schema" or found[label] != [""]:
            rows.append((priority, position, label, text.format(*found[label])))
    return spark.createDataFrame(rows, "priority int, position int, label string, text string")


def report(
    sections: DataFrame, max_tokens: int = MAX_TOKENS, reserved_tokens: int = RESERVED_TOKENS
) -> tuple[str, int, bool]:
    """The sections that fit, most urgent first, with the tokens used and whether one was left out."""
    one = sections.withColumn("report", F.lit(0))
    settings = ("report", "position", "text", "priority", max_tokens, reserved_tokens)
    total = budget_summary(one, *settings).first()
    kept = budget_select(one, *settings).orderBy("priority", "position").collect()
    text = "\n\n".join(row["text"] for row in kept)
    return (text, total["estimated_tokens"], total["truncated"]) if total else ("", 0, False)
