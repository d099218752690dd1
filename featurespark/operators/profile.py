"""Column profiles: nulls, distinct counts, moments, quartiles, mode, histogram, duplicates.

A profile reads its columns twice. The first read folds them into one mergeable state per column; the second counts
values, exactly, and takes distinct counts, modes, histograms and quartiles from the counts. Columns that could be
equal are compared in a third, and a mode that is a long text is read in one more.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Mapping
from dataclasses import field, make_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError
from featurespark.functions.columns import field_of, is_numeric, number_of, ref, type_class, value_of
from featurespark.functions.numeric import equal_width_edges, sample_kurtosis, sample_skewness, sample_std
from featurespark.functions.text import value_text
from featurespark.operators.duplicates import duplicate_of
from featurespark.operators.intervals import Interval, interval_statistics
from featurespark.operators.quantiles import MAX_INSIDE, Target, open_targets, settle
from featurespark.operators.states import column_states, ranks_of
from featurespark.operators.value_counts import NumberPlan, ValueSummary, frequent_modes, value_summary

# Part of the rows by which a sketch may misplace a quartile; beyond it the search goes on in further reads.
SKETCH_ERROR = 0.01
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
HISTOGRAM_BINS = 10

# Names of the fields of a profile.
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("null_count", T.LongType()),
        T.StructField("null_percentage", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("cardinality_ratio", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("quantiles", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("skewness", T.DoubleType()),
        T.StructField("kurtosis", T.DoubleType()),
        T.StructField("is_constant", T.BooleanType()),
        T.StructField("is_duplicate_of", T.StringType()),
        T.StructField("histogram_bins", T.ArrayType(T.DoubleType())),
        T.StructField("histogram_counts", T.ArrayType(T.LongType())),
    ]
)


#: Values of a profile before anything is known; other fields start as None, lists and maps empty.
_START = {
    "null_count": 0, "null_percentage": 0.0, "unique_count": 0, "cardinality_ratio": 0.0, "is_constant": False,
    "size_bytes": 0, "rows": 0,
}
_EMPTY = {T.ArrayType: list, T.MapType: dict}


class _ProfileBase:
    """What a generated profile can do."""

    def record(self) -> dict:
        return {name: getattr(self, name) for name in PROFILE_SCHEMA.fieldNames()}

    def signature(self) -> tuple:
        """What equal columns share in whatever order their rows are added up; rules out duplicates unread."""
        return (self.null_count, self.size_bytes, self.min, self.max)


def _field_of(name: str, kind: type | None) -> tuple:
    if kind in _EMPTY:
        return name, object, field(default_factory=_EMPTY[kind])
    return name, object, field(default=_START.get(name))


# One field for each column of the schema; `size_bytes` and `rows` are kept beside them for the table's size, and the
# `state` of the first read for the second.
ColumnProfile = make_dataclass(
    "ColumnProfile",
    [("name", str), ("dtype", str)]
    + [_field_of(f.name, type(f.dataType)) for f in PROFILE_SCHEMA.fields if f.name not in ("name", "dtype")]
    + [_field_of("size_bytes", None), _field_of("rows", None), _field_of("state", None)],
    bases=(_ProfileBase,),
    module=__name__,
)


def profiles_to_frame(spark: SparkSession, profiles: Iterable[ColumnProfile]) -> DataFrame:
    """One row per column."""
    return spark.createDataFrame([profile.record() for profile in profiles], PROFILE_SCHEMA)


_FIXED_WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def _size_of(member: T.StructField) -> Column:
    """Bytes of a value, null where it is missing: its text's, or those of its type."""
    plain = (T.StringType, T.CharType, T.VarcharType, T.BinaryType)
    if type(member.dataType) in _FIXED_WIDTHS:
        return F.when(value_of(member).isNotNull(), F.lit(_FIXED_WIDTHS[type(member.dataType)])).cast("bigint")
    return F.octet_length(ref(member.name) if isinstance(member.dataType, plain) else value_text(member)).cast("bigint")


def basic_statistics(df: DataFrame, columns: Iterable[str], distinct: str = "exact") -> tuple[int, dict[str, ColumnProfile]]:
    """First read: rows, nulls, size, moments, least and greatest value, and a quantile sketch, one state per column."""
    columns = list(columns)
    members = {name: field_of(df.schema, name) for name in columns}
    numbers = {name: number_of(m) for name, m in members.items() if is_numeric(m)}
    sizes = {name: _size_of(m) for name, m in members.items() if name not in numbers}
    hashes = {}
    if distinct == "approx":
        plain = {name: value_of(m) if is_numeric(m) else value_text(m) for name, m in members.items()}
        hashes = {name: F.when(value.isNotNull(), F.xxhash64(value)) for name, value in plain.items()}
    states = column_states(df, numbers, sizes, hashes)
    rows = states[columns[0]].rows if columns else df.count()
    result = {}
    for name in columns:
        state, width = states[name], _FIXED_WIDTHS.get(type(members[name].dataType))
        nulls = rows - state.filled
        profile = ColumnProfile(
            name=name,
            dtype=type_class(members[name]),
            null_count=nulls,
            null_percentage=round(nulls / rows * 100, 4) if rows else 0.0,
            size_bytes=state.size if width is None else rows * width,
            rows=rows,
            state=state,
        )
        if state.filled and name in numbers:
            profile.mean, profile.min, profile.max = state.average, state.least, state.most
        result[name] = profile
    return rows, result


def _histogram_edges(profile: ColumnProfile) -> list[float]:
    try:
        edges = equal_width_edges(profile.min, profile.max, HISTOGRAM_BINS)
    except DataAccessError:
        return []  # infinite values have no equal-width bins
    return edges if len(edges) > 1 else []


def _read_shape(profile: ColumnProfile, intervals: Mapping[int, Interval]) -> None:
    state = profile.state
    if math.isinf(profile.min) or math.isinf(profile.max):
        profile.std = profile.skewness = profile.kurtosis = math.nan
    elif profile.min == profile.max:
        profile.std = profile.skewness = profile.kurtosis = 0.0
    else:
        profile.std = sample_std(state.finite, state.m2)
        profile.skewness = sample_skewness(state.finite, state.m2, state.m3)
        profile.kurtosis = sample_kurtosis(state.finite, state.m2, state.m4)
    edges = profile.histogram_bins
    if edges:
        counts = [0] * (len(edges) - 1)
        for part in intervals.values():
            # All rows of an interval lie in the bin of its greatest value, since every edge is a cut.
            bin_of = bisect_left(edges, part.greatest) - 1
            counts[bin_of] += part.rows
        profile.histogram_counts = counts


def _number_plan(profile: ColumnProfile, targets: Iterable[Target]) -> NumberPlan:
    """Cuts at the inner edges of the histogram and around the quartiles, where the sketch has them.

    A sketch that lost nothing settles the quartiles at once. Else the values of the intervals around a quartile are
    to be ranked, unless these hold more rows than one window should.
    """
    state = profile.state
    cuts, ranks, near = set(profile.histogram_bins[1:-1]), set(), []
    for target in targets:
        if state.lossless:
            for rank, value in zip(target.ranks, ranks_of(state, target.ranks)):
                target.place(rank, rank, value)
            continue
        ranks |= set(target.ranks)
        slack = max(1, math.ceil(SKETCH_ERROR * state.filled))
        low, *inner, high = ranks_of(state, [max(0, target.ranks[0] - slack), *target.ranks, min(state.filled - 1, target.ranks[1] + slack)])
        around = {math.nextafter(low, -math.inf), high}
        # A value that repeats often has an interval of its own.
        cuts |= around | {point for value in (low, *inner, high) for point in (math.nextafter(value, -math.inf), value)}
        if 2 * slack <= MAX_INSIDE:
            near.append((low, high))
    points = sorted(cuts)
    inside = {bisect_left(points, value) for low, high in near for value in points if low <= value <= high}
    return NumberPlan(points, inside, ranks, max(-profile.min, profile.max) >= 2**53)


def add_value_statistics(df: DataFrame, profiles: Iterable[ColumnProfile], distinct: str) -> None:
    """Second read: quartiles, histograms, distinct counts, and modes of the columns that are not numeric."""
    if distinct not in ("exact", "approx"):
        raise DataAccessError("distinct must be 'exact' or 'approx'")
    profiles = list(profiles)
    numeric = [profile for profile in profiles if profile.mean is not None]
    others = [profile.name for profile in profiles if not is_numeric(field_of(df.schema, profile.name))]
    wanted = {profile.name: list(QUARTILES.values()) for profile in numeric}
    known = {profile.name: (profile.rows - profile.null_count, profile.min, profile.max) for profile in numeric}
    targets = open_targets(wanted, known)
    plans = {}
    for profile in numeric:
        profile.histogram_bins = _histogram_edges(profile)
        plans[profile.name] = _number_plan(profile, [t for t in targets if t.column == profile.name])
    if distinct == "exact":
        plans |= {p.name: NumberPlan([]) for p in profiles if p.name not in others and p.name not in plans}
        found = value_summary(df, plans, others)
    else:
        if any(profile.state.registers is None for profile in profiles):
            _, again = basic_statistics(df, [profile.name for profile in profiles], distinct)
            for profile in profiles:
                profile.state = again[profile.name].state
        found = ValueSummary({p.name: p.state.distinct() if p.state.filled else 0 for p in profiles})
        if plans:
            found.intervals = interval_statistics(df, {name: plan.cuts for name, plan in plans.items()}, {})
        filled = [p.name for p in profiles if p.name in others and p.state.filled]
        found.mode = frequent_modes(df, filled) if filled else {}
    for target in targets:
        for first, last, value in found.hits.get(target.column, ()):
            target.place(first, last, value)
        if not target.solved:
            target.read(found.intervals[target.column])
    settle(df, targets)
    answers = {(target.column, target.fraction): target.answer() for target in targets}
    for profile in numeric:
        _read_shape(profile, found.intervals[profile.name])
        profile.quantiles = {label: answers[profile.name, fraction] for label, fraction in QUARTILES.items()}
        profile.median = profile.quantiles["p50"]
    for profile in profiles:
        profile.unique_count = found.distinct[profile.name]
        profile.cardinality_ratio = round(profile.unique_count / profile.rows, 6) if profile.rows else 0.0
        profile.is_constant = profile.unique_count <= 1
        if profile.name in others:
            profile.mode = found.mode.get(profile.name)


def mark_duplicates(df: DataFrame, profiles: Iterable[ColumnProfile]) -> None:
    profiles = list(profiles)
    known = {profile.name: profile.signature() for profile in profiles}
    found = duplicate_of(df, known.keys(), known)
    for profile in profiles:
        profile.is_duplicate_of = found[profile.name]


def complete_profiles(df: DataFrame, basics: Iterable[ColumnProfile], distinct: str = "exact") -> None:
    """Fill in everything but duplicates, starting from basic statistics."""
    add_value_statistics(df, basics, distinct)


def profile_columns(
    df: DataFrame, columns: Iterable[str] | None = None, distinct: str = "exact", duplicates: bool = True
) -> list[ColumnProfile]:
    """Full profiles in table order; ``distinct="approx"`` estimates distinct counts and modes without shuffling values."""
    names = list(df.columns if columns is None else columns)
    _, basics = basic_statistics(df, names, distinct)
    profiles = [basics[name] for name in names]
    complete_profiles(df, profiles, distinct)
    if duplicates:
        mark_duplicates(df, profiles)
    return profiles


def profile_table(df: DataFrame, columns: Iterable[str] | None = None, distinct: str = "exact") -> DataFrame:
    """The profiles as a DataFrame, one row per column."""
    return profiles_to_frame(df.sparkSession, profile_columns(df, columns, distinct))
