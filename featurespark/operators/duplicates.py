"""Columns that hold equal values in every row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.functions.columns import chunks, field_of, value_of

COLUMNS_PER_JOB = 60


def _comparable(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.map_entries(value_of(field)))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return value_of(field) + F.lit(0.0).cast(field.dataType)  # -0.0 equals 0.0
    return value_of(field)


def _groups(keys: Mapping[str, object]) -> list[list[str]]:
    """Columns with equal keys, in table order, groups of one left out."""
    grouped: dict[object, list[str]] = {}
    for name, key in keys.items():
        grouped.setdefault(key, []).append(name)
    return [names for names in grouped.values() if len(names) > 1]


def _fingerprints(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Null count and a sum of 16-bit row hashes per column: equal for equal columns, safe from overflow."""
    result = {}
    for names in chunks(columns, COLUMNS_PER_JOB):
        aggregates = []
        for index, name in enumerate(names):
            value = _comparable(field_of(df.schema, name))
            aggregates += [
                F.count_if(value.isNull()).alias(f"nulls{index}"),
                F.sum(F.shiftrightunsigned(F.xxhash64(value), 48)).alias(f"hash{index}"),
            ]
        row = df.agg(*aggregates).first()
        for index, name in enumerate(names):
            result[name] = (row[f"nulls{index}"], row[f"hash{index}"])
    return result


def _equal_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    equal = set()
    for part in chunks(pairs, COLUMNS_PER_JOB):
        checks = [
            F.bool_and(_comparable(field_of(df.schema, a)).eqNullSafe(_comparable(field_of(df.schema, b)))).alias(
                f"same{index}"
            )
            for index, (a, b) in enumerate(part)
        ]
        row = df.agg(*checks).first()
        equal |= {pair for index, pair in enumerate(part) if row[index] is not False}
    return equal


def duplicate_of(
    df: DataFrame, columns: Iterable[str] | None = None, known: Mapping[str, tuple] | None = None
) -> dict[str, str | None]:
    """For each column the first other column of the same type that equals it in every row.

    ``known`` may hold statistics already at hand; only columns that agree on them are read again.
    Equality is transitive, so each candidate group is compared with its first member only, and
    columns that differ from it form the next group.
    """
    columns = list(df.columns if columns is None else columns)
    result: dict[str, str | None] = {name: None for name in columns}
    keys = {name: (field_of(df.schema, name).dataType.simpleString(), (known or {}).get(name)) for name in columns}
    tied = [name for group in _groups(keys) for name in group]
    if not tied:
        return result
    prints = _fingerprints(df, tied)
    waiting = _groups({name: (keys[name], prints[name]) for name in tied})
    while waiting:
        equal = _equal_pairs(df, [(group[0], other) for group in waiting for other in group[1:]])
        rest = []
        for group in waiting:
            first = group[0]
            same = [other for other in group[1:] if (first, other) in equal]
            for other in same:
                result[other] = first
            if same:
                result[first] = same[0]
            left = [other for other in group[1:] if other not in same]
            if len(left) > 1:
                rest.append(left)
        waiting = rest
    return result
