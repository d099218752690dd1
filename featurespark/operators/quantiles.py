"""Exact interpolated quantiles without bringing a column's values together.

A bounded sample proposes cut points around each wanted rank; one aggregate then counts the rows
of every interval between the cuts, so the sample guides the search and the counts decide. A rank
whose interval holds a single value, or that is first or last in its interval, is settled by the
interval's bounds. Otherwise the interval is cut again until at most ``MAX_INSIDE`` rows remain,
and only those are ordered. Memory and shuffle stay bounded however long the column is and
however often one value repeats.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurespark.functions.columns import chunks, field_of, number_of
from featurespark.operators.intervals import Interval, interval_statistics, stack_by_interval

SAMPLE_ROWS = 100_000
SKETCH_ACCURACY = 2_000
# Cut points around a wanted rank, in standard errors of the sample.
CUT_OFFSETS = (-4.0, -2.0, -1.0, -0.4, 0.0, 0.4, 1.0, 2.0, 4.0)
MAX_INSIDE = 2_000_000
INTERVALS_PER_JOB = 60


@dataclass
class Target:
    """One quantile of one column: two neighbouring ranks and the interval that holds their values."""

    column: str
    fraction: float
    rows: int
    least: float
    greatest: float
    before: int = 0
    inside: int = 0
    low_value: float | None = None
    high_value: float | None = None

    @property
    def position(self) -> float:
        return self.fraction * (self.rows - 1)

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    @property
    def solved(self) -> bool:
        return self.low_value is not None and self.high_value is not None

    def answer(self) -> float:
        low, high, weight = self.low_value, self.high_value, self.position - self.ranks[0]
        if low == high:
            return low
        return low + (high - low) * weight if weight < 0.5 else high - (high - low) * (1 - weight)

    def place(self, first_rank: int, last_rank: int, value: float) -> None:
        """The rows of ranks first..last all hold this value."""
        low, high = self.ranks
        if first_rank <= low <= last_rank:
            self.low_value = value
        if first_rank <= high <= last_rank:
            self.high_value = value

    def read(self, intervals: Mapping[int, Interval]) -> None:
        """Settle what the interval counts give away; else keep the interval that holds the open rank."""
        before = 0
        for index in sorted(intervals):
            part = intervals[index]
            last = before + part.rows - 1
            if part.least == part.greatest:
                self.place(before, last, part.least)
            else:
                self.place(before, before, part.least)
                self.place(last, last, part.greatest)
            if not self.solved and any(before <= rank <= last for rank in self.ranks):
                keep = (part.least, part.greatest, before, part.rows)
            before += part.rows
        if not self.solved:
            self.least, self.greatest, self.before, self.inside = keep


def open_targets(
    wanted: Mapping[str, Sequence[float]], known: Mapping[str, tuple[int, float, float]]
) -> list[Target]:
    """Targets from each column's row count, least and greatest value; columns without rows have none."""
    return [
        Target(name, fraction, *known[name], inside=known[name][0])
        for name, fractions in wanted.items()
        for fraction in fractions
        if known[name][0]
    ]


def propose_cuts(df: DataFrame, targets: Iterable[Target]) -> dict[str, set[float]]:
    """Cut points per column from a sample of the rows in its targets' intervals.

    Each interval is sampled at its own rate, about ``SAMPLE_ROWS`` rows of it however many it
    holds, so the sketches that tasks send are bounded as well. Each proposed value gets a second
    cut just below it: a value that repeats often then has an interval of its own.
    """
    shared: dict[tuple, list[Target]] = {}
    for target in targets:
        shared.setdefault((target.column, target.least, target.greatest), []).append(target)
    cuts: dict[str, set[float]] = {}
    for part in chunks(list(shared.items()), INTERVALS_PER_JOB):
        sketches = []
        draw = f"draw_{uuid.uuid4().hex}"  # no column of the table
        drawn = df.withColumn(draw, F.rand(17))
        for index, ((name, least, greatest), members) in enumerate(part):
            number = number_of(field_of(df.schema, name))
            taken = (number >= F.lit(least)) & (number <= F.lit(greatest))
            if members[0].inside > SAMPLE_ROWS:
                taken = (F.col(draw) < SAMPLE_ROWS / members[0].inside) & taken
            points = []
            for target in members:
                spread = 0.5 / math.sqrt(min(SAMPLE_ROWS, target.inside)) + 1.0 / SKETCH_ACCURACY
                centre = (target.position - target.before) / target.inside
                points += [min(1.0, max(0.0, centre + offset * spread)) for offset in CUT_OFFSETS]
            wanted = F.expr(f"array({', '.join(f'{point!r}D' for point in points)})")
            sketches.append(F.percentile_approx(F.when(taken, number), wanted, SKETCH_ACCURACY).alias(f"cuts{index}"))
        row = drawn.agg(*sketches).first()
        for index, ((name, _, _), _) in enumerate(part):
            for value in row[f"cuts{index}"] or []:
                cuts.setdefault(name, set()).update((math.nextafter(value, -math.inf), value))
    return cuts


def _with_bounds(cuts: Mapping[str, set[float]], targets: Iterable[Target]) -> dict[str, list[float]]:
    """The cuts plus the bounds of each target's interval, sorted."""
    points = {name: set(values) for name, values in cuts.items()}
    for target in targets:
        points.setdefault(target.column, set()).update((math.nextafter(target.least, -math.inf), target.greatest))
    return {name: sorted(values) for name, values in points.items()}


def settle(df: DataFrame, targets: Iterable[Target]) -> None:
    """Cut the intervals of open targets until they are small, then order what is left."""
    waiting = [target for target in targets if not target.solved]
    large = [target for target in waiting if target.inside > MAX_INSIDE]
    while large:
        names = {target.column for target in large}
        again = [target for target in waiting if target.column in names]
        statistics = interval_statistics(df, _with_bounds(propose_cuts(df, large), again), {})
        for target in again:
            target.read(statistics[target.column])
        waiting = [target for target in waiting if not target.solved]
        large = [target for target in waiting if target.inside > MAX_INSIDE]
    order_inside(df, waiting)


def order_inside(df: DataFrame, targets: Sequence[Target]) -> None:
    """Read the wanted ranks from the value counts of the rows in each target's interval."""
    by_column: dict[str, list[Target]] = {}
    for target in targets:
        by_column.setdefault(target.column, []).append(target)
    for names in chunks(list(by_column), INTERVALS_PER_JOB):
        cuts = _with_bounds({}, [target for name in names for target in by_column[name]])
        long = stack_by_interval(df, {name: cuts[name] for name in names})
        members, hit, inside = {}, F.lit(False), F.lit(False)
        for position, name in enumerate(names):
            intervals: set[int] = set()
            for target in by_column[name]:
                interval = cuts[name].index(target.greatest)
                members.setdefault((position, interval), []).append(target)
                intervals.add(interval)
                at_target = (F.col("column") == position) & (F.col("interval") == interval)
                for rank in target.ranks:
                    offset = F.lit(rank - target.before)
                    hit = hit | (at_target & (F.col("upto") > offset) & (F.col("upto") - F.col("n") <= offset))
            inside = inside | ((F.col("column") == position) & F.col("interval").isin(*intervals))
        counts = long.where(inside).groupBy("column", "interval", "value").agg(F.count("*").alias("n"))
        # At most MAX_INSIDE rows per interval reach this window.
        window = Window.partitionBy("column", "interval").orderBy("value")
        for row in counts.withColumn("upto", F.sum("n").over(window)).where(hit).collect():
            for target in members[row["column"], row["interval"]]:
                last = target.before + row["upto"] - 1
                target.place(last - row["n"] + 1, last, row["value"])


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict[float, float]]:
    """Interpolated quantiles of numeric columns, nulls and NaN left out; a column without values gives {}."""
    result: dict[str, dict[float, float]] = {name: {} for name in wanted}
    if not wanted:
        return result
    whole = interval_statistics(df, {name: [] for name in wanted}, {})
    known = {
        name: (part[0].rows, part[0].least, part[0].greatest) if part else (0, 0.0, 0.0) for name, part in whole.items()
    }
    targets = open_targets(wanted, known)
    points = {name: sorted(values) for name, values in propose_cuts(df, targets).items()}
    statistics = interval_statistics(df, points, {}) if points else {}
    for target in targets:
        target.read(statistics[target.column])
    settle(df, targets)
    for target in targets:
        result[target.column][target.fraction] = target.answer()
    return result
