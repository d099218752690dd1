"""Statistics of numeric columns per value interval, in one scan and one small shuffle.

Every column has its own sorted cut points; a value v falls into interval k when exactly k cuts
are below it, so intervals are closed on the right. All columns are stacked into one narrow
stream and share one short expression, which keeps the generated code small enough to compile
however many columns there are. Each task sends at most one row per column and interval.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.functions.columns import chunks, field_of, number_of

COLUMNS_PER_JOB = 60


@dataclass(frozen=True)
class Interval:
    """The rows of one column in one interval; ``sums`` holds centred powers one to four."""

    rows: int
    least: float
    greatest: float
    sums: tuple[float, float, float, float]


def _double(number: float) -> str:
    if number != number:
        return "double('NaN')"
    if number in (float("inf"), float("-inf")):
        return f"double('{'-' if number < 0 else ''}Infinity')"
    return f"{float(number)!r}D"


def _array(items: Sequence[str]) -> str:
    return f"array({', '.join(items)})"


def stack_by_interval(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows (column, value, interval) of the numeric columns named by ``cuts``, missing values left out.

    ``column`` is the position of the name in ``cuts``. Cuts are padded to a full binary search tree.
    """
    numbers = [number_of(field_of(df.schema, name)) for name in cuts]
    long = df.select(F.posexplode(F.array(*numbers)).alias("column", "value")).where(F.col("value").isNotNull())
    return with_interval(long, cuts).select("column", "value", "interval")


def with_interval(long: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows with `column` (a position in ``cuts``) and `value`, and the `interval` that the value falls into."""
    names, kept = list(cuts), long.columns
    depth = max(len(cuts[name]) for name in names).bit_length()
    width = 2**depth - 1
    interval = F.lit(0)
    if depth:
        padded = [list(cuts[name]) + [float("inf")] * (width - len(cuts[name])) for name in names]
        table = F.expr(_array([_array([_double(cut) for cut in row]) for row in padded]))
        long = long.withColumn("cuts", F.get(table, F.col("column")))
        # Each round adds one bit to the number of cuts known to lie below the value.
        for level in reversed(range(depth)):
            step = 2**level
            above = F.col("value") > F.get("cuts", interval + (step - 1))
            long = long.withColumn(f"interval{level}", F.when(above, interval + step).otherwise(interval))
            interval = F.col(f"interval{level}")
    return long.select(*kept, interval.alias("interval"))


def interval_statistics(
    df: DataFrame, cuts: Mapping[str, Sequence[float]], centres: Mapping[str, float]
) -> dict[str, dict[int, Interval]]:
    """For each column the non-empty intervals between its cuts; powers are taken around the column's centre."""
    result: dict[str, dict[int, Interval]] = {name: {} for name in cuts}
    for names in chunks(list(cuts), COLUMNS_PER_JOB):
        centre_table = F.expr(_array([_double(centres.get(name, 0.0)) for name in names]))
        long = stack_by_interval(df, {name: cuts[name] for name in names})
        offset = F.col("value") - F.get(centre_table, F.col("column"))
        long = long.withColumn("offset", offset)
        square = F.col("offset") * F.col("offset")
        table = long.groupBy("column", "interval").agg(
            F.count("*").alias("rows"),
            F.min("value").alias("least"),
            F.max("value").alias("greatest"),
            F.sum("offset").alias("s1"),
            F.sum(square).alias("s2"),
            F.sum(square * F.col("offset")).alias("s3"),
            F.sum(square * square).alias("s4"),
        )
        # Bounded: columns times intervals.
        for row in table.collect():
            sums = (row["s1"], row["s2"], row["s3"], row["s4"])
            result[names[row["column"]]][row["interval"]] = Interval(row["rows"], row["least"], row["greatest"], sums)
    return result
