"""Spearman correlation of any number of columns with gaps, in two shuffles of single values.

Pandas ranks the rows that both columns of a pair share, so the rank of a value depends on the other column
only through the rows in which that is missing. Columns missing in the same rows ask for the same ranks. All
values of all columns are therefore sorted together once, with a mark of what else their rows hold; one pass
over the sorted values gives each of them its average rank under every such condition; the ranks go back to
their rows, where products are added up. Equal values may lie in several partitions: the partitions' sums, a
row per partition and column, settle their ranks, so no value has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.functions.columns import chunks, field_of, number_of
from featurespark.session import cut_lineage

#: Columns whose presence one number tells.
MARKS = 62

#: Values that a task sorts, about; with fewer than so many such parts in all, Spark chooses the number of tasks.
PART_VALUES, LEAST_PARTS = 1 << 19, 8

#: Conditions whose ranks weigh as much as the rest of a value.
PART_RANKS = 8


def _parts(values: int) -> list[int]:
    """The number of partitions that so many values need, as leading arguments of a repartition; none for a small table."""
    parts = -(-values // PART_VALUES)
    return [parts] if parts >= LEAST_PARTS else []


def sorted_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, row, there, part): one row per value, in order over the partitions, held in a checkpoint.

    `there` has a bit for each column that its row holds. `part` is the number of the partition.
    """
    keys = [f"c{index}" for index in range(len(columns))]
    numbers = [
        (number_of(field_of(df.schema, name)) + F.lit(0.0)).alias(key)  # -0.0 becomes 0.0
        for name, key in zip(columns, keys)
    ]
    slim = df.select(F.monotonically_increasing_id().alias("row"), *numbers)
    bits = [
        sum((F.when(F.col(key).isNotNull(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, key in enumerate(part)), F.lit(0))
        for part in chunks(keys, MARKS)
    ]
    there = F.array(*[bit.cast("bigint") for bit in bits]).alias("there")
    long = slim.select("row", there, F.posexplode(F.array(*keys)).alias("column", "value")).where("value IS NOT NULL")
    order = ["column", "value", "row"]
    filled = F.size(F.array_compact(F.array(*keys)))
    parts = _parts(slim.agg(F.sum(filled)).first()[0] or 0)
    placed = long.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
    return cut_lineage(placed.select(*order, "there", F.spark_partition_id().alias("part")))


def _conditions(values: DataFrame, size: int) -> tuple[np.ndarray, list[int]]:
    """For each column the condition under which others are ranked against it, and a column that stands for each.

    Condition 0 holds in all rows. Columns that imply each other share a condition. One row per column is read.
    """
    words = -(-size // MARKS)
    always = values.groupBy("column").agg(
        *[F.bit_and(F.get("there", F.lit(word))).alias(f"w{word}") for word in range(words)]
    )
    implied = np.ones((size, size), bool)
    for row in always.collect():
        for other in range(size):
            implied[row["column"], other] = bool(row[f"w{other // MARKS}"] >> (other % MARKS) & 1)
    condition, stands = np.zeros(size, np.int64), [-1]
    for column in range(size):
        if implied[:, column].all():
            continue
        alike = [k for k in range(1, len(stands)) if implied[column, stands[k]] and implied[stands[k], column]]
        if not alike:
            stands.append(column)
        condition[column] = alike[0] if alike else len(stands) - 1
    return condition, stands


def _presence(stands: Sequence[int]):
    """A function from marks to a row per value and a column per condition, 1 where it holds."""

    def presence(marks):
        import numpy as np

        there = np.ones((len(marks), len(stands)), np.int64)
        for k, column in enumerate(stands):
            if k:
                there[:, k] = marks[:, column // MARKS] >> (column % MARKS) & 1
        return there

    return presence


def _summaries(values: DataFrame, stands: Sequence[int]) -> list:
    """Per partition and column: counts of all its values and of its first and last one, under each condition."""
    presence = _presence(stands)

    def summarise(batches):
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            columns, numbers = batch.column("column").to_numpy(), batch.column("value").to_numpy()
            there = presence(batch.column("there").flatten().to_numpy().reshape(batch.num_rows, -1))
            edges = np.flatnonzero(np.diff(columns, prepend=columns[0] - 1, append=columns[-1] + 1))
            for low, high in zip(edges[:-1], edges[1:]):
                inside, counts = numbers[low:high], there[low:high]
                first, last = inside[0], inside[-1]
                own = [first, last, counts.sum(0), counts[inside == first].sum(0), counts[inside == last].sum(0)]
                held = found.get(int(columns[low]))
                if held is not None:  # goes on from the batch before
                    if first == held[0]:
                        held[3] = held[3] + own[3]
                    own[4] = own[4] + held[4] if last == held[1] else own[4]
                    own = [held[0], last, held[2] + own[2], held[3], own[4]]
                found[int(columns[low])] = own
        rows = [(part, column, first, last, *(x.astype("<i8").tobytes() for x in sums))
                for column, (first, last, *sums) in found.items()]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "column", "first", "last", "all", "head", "tail"]
            )

    schema = "part int, column int, first double, last double, all binary, head binary, tail binary"
    return sorted(values.mapInArrow(summarise, schema).collect(), key=lambda r: (r["column"], r["part"]))


def _offsets(summaries: list, size: int, width: int) -> tuple[dict, np.ndarray]:
    """What precedes each partition's values, what its first and last value have elsewhere, and all counts."""
    totals, offsets = np.zeros((size, width), np.int64), {}
    nothing = np.zeros(width, np.int64)

    def counts(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<i8")

    open_ = (None, None, nothing)  # column, value, and its rows so far
    for row in summaries:
        column = row["column"]
        earlier = open_[2] if open_[:2] == (column, row["first"]) else nothing
        offsets[row["part"], column] = [totals[column].copy(), earlier, nothing]
        totals[column] += counts(row["all"])
        whole = row["first"] == row["last"]
        open_ = (column, row["last"], counts(row["tail"]) + (earlier if whole else nothing))
    open_ = (None, None, nothing)
    for row in reversed(summaries):
        column = row["column"]
        later = open_[2] if open_[:2] == (column, row["last"]) else nothing
        offsets[row["part"], column][2] = later
        whole = row["first"] == row["last"]
        open_ = (column, row["first"], counts(row["head"]) + (later if whole else nothing))
    return offsets, totals


def ranker(places, stands: Sequence[int]):
    """A function from the batches of a partition to those of its ranks, none larger than the largest that came in.

    `places` gives what `_offsets` found and the mean ranks. The rank of the last value of a batch is known only when
    the value has ended; until then its row numbers and marks are kept, and counts instead of all else.
    """
    presence, width = _presence(stands), len(stands)

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        offsets, middle = places()
        seen: dict = {}
        waiting = None  # part, column, value, counts, and pieces of (rows, marks) of a value that may go on

        def begin_of_runs(values):
            return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))

        def given(column, rows, found):
            raw = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(found, "<f8"))]
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(np.full(len(rows), column, np.int32)), raw.cast(pa.binary())], ["row", "column", "ranks"]
            )

        def averages(part, column, sizes, ends):
            """Centred ranks of the next values of a column; `ends` when the partition has no further one."""
            start, earlier, later = offsets[part, column]
            smaller = start + seen.get(column, np.zeros(width, np.int64)) + np.cumsum(sizes, 0) - sizes
            ties = sizes.copy()
            if column not in seen:
                smaller[0] -= earlier
                ties[0] += earlier
            if ends:
                ties[-1] += later
            seen[column] = seen.get(column, 0) + sizes.sum(0)
            return smaller + (ties + 1) / 2 - middle[column]

        def settle(ends):
            """The rows of the waiting value, piece by piece."""
            part, column, _, counts, pieces = waiting
            own = averages(part, column, counts[None], ends)
            while pieces:
                rows, marks = pieces.pop(0)
                yield given(column, rows, own * presence(marks))

        for batch in batches:
            if not batch.num_rows:
                continue
            part, columns = batch.column("part")[0].as_py(), batch.column("column").to_numpy()
            numbers, rows = batch.column("value").to_numpy(), batch.column("row").to_numpy()
            marks = batch.column("there").flatten().to_numpy().reshape(batch.num_rows, -1)
            there = presence(marks)
            begins = begin_of_runs(columns)
            for low, high in zip(begins, np.append(begins[1:], len(columns))):
                column = int(columns[low])
                edges = begin_of_runs(numbers[low:high]) + low
                sizes = np.add.reduceat(there[:high], edges, 0)
                if waiting is not None and waiting[1:3] == (column, numbers[low]):
                    end = edges[1] if len(edges) > 1 else high
                    waiting = (*waiting[:3], waiting[3] + sizes[0], waiting[4])
                    waiting[4].append((rows[low:end].copy(), marks[low:end].copy()))
                    edges, sizes = edges[1:], sizes[1:]
                    if not len(edges):
                        continue
                if waiting is not None:
                    yield from settle(waiting[1] != column)
                cut = edges[-1]
                if len(edges) > 1:
                    own = averages(part, column, sizes[:-1], False)
                    found = np.repeat(own, np.diff(edges), 0) * there[edges[0] : cut]
                    yield given(column, rows[edges[0] : cut], found)
                waiting = (part, column, numbers[cut], sizes[-1], [(rows[cut:high].copy(), marks[cut:high].copy())])
        if waiting is not None:
            yield from settle(True)

    return rank


def centred_ranks(values: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(row, column, ranks): the average rank of each value under each condition, less the mean rank; 0 where the
    condition does not hold. Also the condition of each column and the counts per column and condition."""
    condition, stands = _conditions(values, size)
    # One row per partition and column.
    offsets, totals = _offsets(_summaries(values, stands), size, len(stands))
    held = values.sparkSession.sparkContext.broadcast((offsets, (totals + 1) / 2))
    rank = ranker(lambda: held.value, stands)
    return values.mapInArrow(rank, "row bigint, column int, ranks binary"), condition, totals


def rank_correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """(a, b, corr) for all ordered pairs of positions in `columns`: Pearson on average ranks of the rows that both
    columns hold; 0 where one of them does not vary in these rows."""
    size = len(columns)
    ranks, condition, totals = centred_ranks(sorted_values(df, columns), size)
    width = totals.shape[1]

    def products(batches):
        import numpy as np
        import pyarrow as pa

        cross, square = np.zeros((size, size)), np.zeros((size, size))

        def add(rows, places, found):
            number = np.cumsum(np.diff(rows, prepend=rows[0]) != 0)
            table = np.zeros((int(number[-1]) + 1, size, width))
            table[number, places] = found
            if width == 1:
                cross[:] += table[:, :, 0].T @ table[:, :, 0]
                return
            for a in range(size):
                own = table[:, a, condition]
                cross[a] += (own * table[:, :, condition[a]]).sum(0)
                square[a] += (own * own).sum(0)

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(-1, width)
            if rest is not None:
                rows, places, found = (np.concatenate(pair) for pair in zip(rest, (rows, places, found)))
            cut = int(np.searchsorted(rows, rows[-1]))
            rest = rows[cut:], places[cut:], found[cut:]
            if cut:
                add(rows[:cut], places[:cut], found[:cut])
        if rest is not None:
            add(*rest)
        if width == 1:
            square = np.repeat(np.diag(cross)[:, None], size, 1)
        a, b = np.triu_indices(size)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((a, b, cross[a, b], square[a, b], square[b, a]), kinds)],
            ["a", "b", "cross", "left", "right"],
        )

    schema = "a int, b int, cross double, left double, right double"
    parts = _parts(int(totals[:, 0].sum()) * -(-width // PART_RANKS))
    dealt = ranks.repartition(*parts, "row").sortWithinPartitions("row")
    place = F.col("id")
    nothing = df.sparkSession.range(size * size).select(
        F.floor(place / size).cast("int").alias("a"), (place % size).cast("int").alias("b"),
        *[F.lit(0.0).alias(name) for name in ("cross", "left", "right")],
    )
    sums = dealt.mapInArrow(products, schema).unionByName(nothing.where("a <= b"))
    sums = sums.groupBy("a", "b").agg(*[F.sum(name).alias(name) for name in ("cross", "left", "right")])
    spread = F.col("left") * F.col("right")
    plain = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cross") / F.sqrt(spread)))).otherwise(0.0)
    corr = F.when((F.col("a") == F.col("b")) & (spread > 0), F.lit(1.0)).otherwise(plain)
    rounded = F.round(corr, digits) + F.lit(0.0)
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    ordered = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    return sums.select(F.explode(ordered).alias("pair"), rounded.alias("corr")).select("pair.a", "pair.b", "corr")
