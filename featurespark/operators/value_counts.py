"""Distinct counts, modes, interval counts and ranked values of many columns from one count per value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.functions.columns import chunks, field_of, number_of, ref, value_of
from featurespark.functions.text import value_text
from featurespark.operators.intervals import Interval, with_interval
from featurespark.session import cut_lineage

#: Numeric columns of one query.
COLUMNS_PER_JOB = 120


def _carrier(field: T.StructField) -> tuple[T.DataType, Column]:
    """The type in which a column's values are grouped: columns of one carrier share a scan."""
    kind = field.dataType
    if isinstance(kind, T.IntegralType):
        return T.LongType(), value_of(field).cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType(), value_of(field).cast("double")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.CharType, T.VarcharType)):
        return T.StringType(), value_text(field)
    return kind, value_of(field)


def value_counts(df: DataFrame, columns: Iterable[str]) -> list[tuple[T.DataType, DataFrame]]:
    """Per carrier type, rows (column position, value, n) without missing values.

    Rows are counted on the map side before the shuffle, so a value that fills a third of the
    table arrives as one row per task.
    """
    positions = {name: index for index, name in enumerate(df.columns)}
    groups: dict[T.DataType, list[tuple[str, Column]]] = {}
    for name in columns:
        carrier, value = _carrier(field_of(df.schema, name))
        groups.setdefault(carrier, []).append((name, value))
    result = []
    for carrier, members in groups.items():
        ids = F.array(*[F.lit(positions[name]) for name, _ in members])
        stacked = F.posexplode(F.array(*[value for _, value in members])).alias("member", "value")
        long = df.select(stacked).where(F.col("value").isNotNull())
        counts = long.groupBy("member", "value").agg(F.count("*").alias("n"))
        result.append((carrier, counts.select(F.get(ids, F.col("member")).alias("column"), "value", "n")))
    return result


#: Texts of so many bytes or fewer are counted as they are, longer ones by a digest of one byte more.
SHORT_BYTES = 15

#: Characters of a long text that are counted with its digest.
HEAD = 16

HITS = "array<struct<first:bigint,last:bigint,value:double>>"


@dataclass
class NumberPlan:
    """What to learn of a numeric column: counts between its cuts, and the values at the ranks within `inside`.

    `large` says that the column has whole numbers which a double doesn't tell apart.
    """

    cuts: list[float]
    inside: set[int] = field(default_factory=set)
    ranks: set[int] = field(default_factory=set)
    large: bool = False


@dataclass
class ValueSummary:
    """Distinct counts and modes; for numeric columns intervals, and (first rank, last rank, value) of wanted ranks."""

    distinct: dict[str, int] = field(default_factory=dict)
    mode: dict[str, str | None] = field(default_factory=dict)
    intervals: dict[str, dict[int, Interval]] = field(default_factory=dict)
    hits: dict[str, list[tuple[int, int, float]]] = field(default_factory=dict)


def _exact_rest(member: T.StructField, plan: NumberPlan) -> Column | None:
    """What tells values apart that are one double: the text of decimals and of whole numbers beyond 2**53."""
    if isinstance(member.dataType, T.DecimalType):
        return ref(member.name).cast("string") if member.dataType.precision > 15 else None
    if isinstance(member.dataType, T.LongType) and plan.large:
        return F.when(F.abs(number_of(member)) >= 2.0**53, ref(member.name).cast("string"))
    return None


def _numbers_summary(df: DataFrame, plans: Mapping[str, NumberPlan]) -> DataFrame:
    """One row per column and interval: rows, distinct values, bounds, and the values at wanted ranks.

    Values are counted, then the counts outside the intervals of interest are added up, so that few rows per column
    are left to be ranked: its intervals, and the distinct values of those that the sketch put around a quartile.
    """
    members = [field_of(df.schema, name) for name in plans]
    numbers = [(number_of(m) + F.lit(0.0)).alias("value") for m in members]
    rests = [_exact_rest(m, plan) for m, plan in zip(members, plans.values())]
    if any(rest is not None for rest in rests):
        nothing = F.lit(None).cast("string")
        cells = [F.struct(v, (nothing if r is None else r).alias("rest")) for v, r in zip(numbers, rests)]
        long = df.select(F.posexplode(F.array(*cells)).alias("column", "cell"))
        long = long.select("column", F.col("cell.value").alias("value"), F.col("cell.rest").alias("rest"))
    else:
        long = df.select(F.posexplode(F.array(*numbers)).alias("column", "value"))
    keys = ["column", "value"] + ["rest"] * ("rest" in long.columns)
    counts = long.where("value IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))
    counts = with_interval(counts, {name: plan.cuts for name, plan in plans.items()})

    def table(sets: Iterable[set[int]], kind: str) -> Column:
        own = F.array(*[F.array(*map(F.lit, sorted(x))).cast(f"array<{kind}>") for x in sets])
        return F.get(own, F.col("column"))

    inside = F.array_contains(table((plan.inside for plan in plans.values()), "int"), F.col("interval"))
    points = counts.groupBy("column", "interval", F.when(inside, F.col("value")).alias("point")).agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    # As many rows of a column meet as the sketch promised around its quartiles, see MAX_INSIDE.
    order = Window.partitionBy("column").orderBy("interval", "point").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.withColumn("last", F.sum("n").over(order) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    ranks = table((plan.ranks for plan in plans.values()), "bigint")
    hit = F.col("point").isNotNull() & F.exists(ranks, lambda rank: rank.between(F.col("first"), F.col("last")))
    hits = F.collect_list(F.when(hit, F.struct("first", "last", F.col("point").alias("value"))))
    return placed.groupBy("column", "interval").agg(
        F.sum("n").alias("n"), F.sum("distinct").alias("distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
        hits.alias("hits"),
    ).select(F.lit("number").alias("kind"), "column", "interval", "n", "distinct", "low", "high", F.lit(None).cast("string").alias("text"), "hits")


def _digest(text: Column) -> Column:
    """A short text itself, else its digest, which is longer than any short text."""
    return F.when(F.octet_length(text) <= SHORT_BYTES, text.cast("binary")).otherwise(F.unhex(F.md5(text.cast("binary"))))


def _texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (member, text) of text columns and of columns shown as text."""
    texts = F.array(*[_carrier(field_of(df.schema, name))[1] for name in names])
    return df.select(F.posexplode(texts).alias("member", "text")).where("text IS NOT NULL")


def _texts_summary(df: DataFrame, names: Sequence[str], positions: Mapping[str, int]) -> DataFrame:
    """Texts are counted by digest; of the most frequent ones the first by its beginning."""
    head = F.left("text", F.lit(HEAD)).alias("head")
    counts = _texts(df, names).select("member", _digest(F.col("text")).alias("key"), head)
    counts = counts.groupBy("member", "key", "head").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("order"), "head"))
    found = counts.groupBy("member").agg(F.count("*").alias("distinct"), best.alias("best"))
    ids = F.array(*[F.lit(positions[name]) for name in names])
    return found.select(
        F.lit("text").alias("kind"), F.get(ids, F.col("member")).alias("column"), F.lit(0).alias("interval"),
        (-F.col("best.order")).alias("n"), "distinct", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.col("best.head").alias("text"),
        F.lit(None).cast(HITS).alias("hits"),
    )


def _others_summary(df: DataFrame, columns: Iterable[str]) -> Iterator[DataFrame]:
    for carrier, counts in value_counts(df, columns):
        best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
        part = counts.groupBy("column").agg(F.count("*").alias("distinct"), best.alias("best"))
        part = part.select("column", "distinct", F.col("best.value").alias("value"))
        yield part.select(
            F.lit("other").alias("kind"), "column", F.lit(0).alias("interval"), F.lit(0).cast("bigint").alias("n"), "distinct",
            F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), value_text(T.StructField("value", carrier)).alias("text"),
            F.lit(None).cast(HITS).alias("hits"),
        )


def _long_modes(df: DataFrame, ties: Mapping[str, tuple[int, str]]) -> dict[str, str]:
    """The first of the texts that occur `n` times and begin with `head`; only texts with that beginning are read on.

    Where the counts are 1 all of them do. Otherwise their digests are counted again and looked up; they are few unless
    very many texts share count and beginning. The columns of one call have counts of one of these kinds.
    """
    names = list(ties)
    heads, wanted = (F.array(*[F.lit(ties[name][k]) for name in names]) for k in (1, 0))
    rows = _texts(df, names).where(F.left("text", F.lit(HEAD)) == F.get(heads, F.col("member")))
    if any(n > 1 for n, _ in ties.values()):
        keyed = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
        counts = keyed.groupBy("member", "key").agg(F.count("*").alias("n"))
        best = cut_lineage(counts.where(F.col("n") == F.get(wanted, F.col("member"))).select("member", "key"))
        few = best.limit(FEW_DIGESTS + 1).count() <= FEW_DIGESTS
        rows = keyed.join(F.broadcast(best) if few else best, ["member", "key"], "left_semi")
    found = rows.groupBy("member").agg(F.min("text").alias("text"))
    return {names[row["member"]]: row["text"] for row in found.collect()}


#: Digests that are looked up in a broadcast table.
FEW_DIGESTS = 1_000_000


def value_summary(df: DataFrame, numbers: Mapping[str, NumberPlan], others: Iterable[str]) -> ValueSummary:
    """Exact distinct counts and modes, counts between cuts and values at wanted ranks, all from one count per value.

    What is shuffled is one row per distinct value and task: numbers themselves, short texts, digests of long texts.
    The mode is the smallest of the most frequent values. A long mode is read in a second scan.
    """
    others = list(others)
    positions = {name: index for index, name in enumerate(df.columns)}
    result = ValueSummary({name: 0 for name in [*numbers, *others]}, {name: None for name in others})
    result.intervals, result.hits = ({name: type_() for name in numbers} for type_ in (dict, list))
    as_text = [name for name in others if isinstance(_carrier(field_of(df.schema, name))[0], T.StringType)]
    parts = list(_others_summary(df, [name for name in others if name not in as_text]))
    if as_text:
        parts.append(_texts_summary(df, as_text, positions))
    groups = chunks(list(numbers), COLUMNS_PER_JOB)
    for group in groups or [[]]:
        here = [_numbers_summary(df, {name: numbers[name] for name in group})] if group else []
        here += parts
        parts = []
        for row in _union(here).collect() if here else []:
            if row["kind"] == "number":
                name = group[row["column"]]
                result.intervals[name][row["interval"]] = Interval(row["n"], row["low"], row["high"], (0.0, 0.0, 0.0, 0.0))
                result.distinct[name] += row["distinct"]
                result.hits[name] += [tuple(hit) for hit in row["hits"]]
            else:
                name = df.columns[row["column"]]
                result.distinct[name], result.mode[name] = row["distinct"], row["text"]
                if row["kind"] == "text" and len(row["text"]) == HEAD:
                    result.mode[name] = (row["n"], row["text"])
    ties = {name: mode for name, mode in result.mode.items() if isinstance(mode, tuple)}
    for part in ({k: v for k, v in ties.items() if v[0] == 1}, {k: v for k, v in ties.items() if v[0] > 1}):
        if part:
            result.mode.update(_long_modes(df, part))
    return result


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def frequent_modes(df: DataFrame, columns: Sequence[str], items: int = 1_000) -> dict[str, str | None]:
    """Modes of columns from a bounded list of frequent values per task.

    Each task keeps the `items` hashes that it counts most often by the rule of frequent items: a count is lowered by
    what had to be forgotten, so any value in more than one of `items` rows is kept. The value of the best hash is read
    in a second scan. Without such a value the answer is one of the values.
    """
    names, size = list(columns), len(list(columns))
    values = {name: _carrier(field_of(df.schema, name)) for name in names}

    def frequent(batches):
        import numpy as np
        import pyarrow as pa

        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(size)]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                found, n = np.unique(column.drop_null().to_numpy(), return_counts=True)
                keys, at = np.unique(np.concatenate((held[k][0], found)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((held[k][1], n)), len(keys)).astype(np.int64)
                if len(keys) > items:
                    counts -= np.partition(counts, -items - 1)[-items - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
                held[k] = keys, counts
        for k, (keys, counts) in enumerate(held):
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(counts)], names=["member", "key", "n"]
                )

    hashes = [F.xxhash64(v).alias(f"h{k}") for k, (_, v) in enumerate(values.values())]
    present = [F.when(v.isNotNull(), h).alias(f"h{k}") for k, ((_, v), h) in enumerate(zip(values.values(), hashes))]
    sums = df.select(*present).mapInArrow(frequent, "member int, key bigint, n bigint").groupBy("member", "key").agg(F.sum("n").alias("n"))
    best = {r["member"]: r["key"] for r in sums.groupBy("member").agg(F.max_by("key", F.struct("n", "key")).alias("key")).collect()}
    read = []
    for k, (name, (carrier, value)) in enumerate(values.items()):
        chosen = F.when(F.xxhash64(value) == F.lit(best.get(k)), value) if k in best else F.min(value)
        read.append((F.min(chosen) if k in best else chosen).alias(f"m{k}"))
    shown = [value_text(T.StructField(f"m{k}", carrier)).alias(f"m{k}") for k, (carrier, _) in enumerate(values.values())]
    row = df.agg(*read).select(*shown).first()
    return {name: row[f"m{k}"] for k, name in enumerate(names)}


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row with the column's most frequent value in its own type, smallest first among equals."""
    value = value_of(field_of(df.schema, column)).alias("value")
    counts = df.select(value).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
    return counts.agg(best.alias("best")).select(F.col("best.value").alias("value"))
