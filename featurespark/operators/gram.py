"""Pearson correlation of any number of columns in one read: co-moments per task, merged block by block.

Each task adds up its rows as matrix products over the columns: how many rows two columns share, and around
the means of those rows their squares and products. A state is cut into tiles of column pairs; the states
of a tile are merged first within salted groups of tasks and then over the groups, by the formula for
merging centred moments, so that no sum is taken around a distant centre. The number of jobs does not
depend on the number of columns, and no row ever leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.functions.columns import chunks, field_of, number_of

#: Columns on each side of a tile, and groups of tasks whose states of a tile are merged first.
TILE, SALTS = 16, 64

#: Columns whose pairs one task holds at once; wider tables are read once for each pair of blocks of half as many.
WIDE = 1_000

STATE_SCHEMA = "low int, high int, salt int, state binary"


def pair_correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """(a, b, corr) for all ordered pairs of positions in `columns`; undefined coefficients are 0.

    Pairs use the rows in which both columns have a value. A coefficient is undefined when one of the columns
    does not vary in these rows or holds infinite values; a column is always fully correlated with itself.
    """
    if len(columns) > WIDE:
        return _wide(df, columns, digits)
    size, tile, salts = len(columns), TILE, SALTS

    # Nested so that the functions travel to the workers by value.
    def merge(one, two):
        """States are (rows, least, greatest, mean, squares, products) of shape tile x tile, both orders of a pair."""
        import numpy as np

        n = one["n"] + two["n"]
        some = np.maximum(n, 1)
        with np.errstate(all="ignore"):
            delta, swapped = two["mean"] - one["mean"], two["mean2"] - one["mean2"]
            weight = one["n"] * two["n"] / some
            # With no rows on one side the other side's values stay as they are.
            delta, swapped = np.where(weight > 0, delta, 0.0), np.where(weight > 0, swapped, 0.0)
            out = {"n": n, "cross": one["cross"] + two["cross"] + delta * swapped * weight}
            for mark, step in (("", delta), ("2", swapped)):
                mean = np.where(one["n"] > 0, one[f"mean{mark}"], two[f"mean{mark}"])
                out[f"mean{mark}"] = mean + step * two["n"] / some
                out[f"square{mark}"] = one[f"square{mark}"] + two[f"square{mark}"] + step * step * weight
                out[f"least{mark}"] = np.minimum(one[f"least{mark}"], two[f"least{mark}"])
                out[f"most{mark}"] = np.maximum(one[f"most{mark}"], two[f"most{mark}"])
        return out

    fields = ("n", "cross", "mean", "mean2", "square", "square2", "least", "least2", "most", "most2")

    def pack(state):
        import numpy as np

        return np.stack([state[f] for f in fields]).astype(np.float64).tobytes()

    def unpack(raw, low, high):
        import numpy as np

        shape = (min(tile, size - low * tile), min(tile, size - high * tile))
        return dict(zip(fields, np.frombuffer(raw, np.float64).reshape(len(fields), *shape)))

    def tiles():
        last = -(-size // tile)
        return [(low, high) for low in range(last) for high in range(low, last)]

    def moments(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shape = (size, size)
        n, least, most = np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)
        mean, square, cross = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            there = ~np.isnan(values)
            with np.errstate(all="ignore"):
                # Rows of these matrices are a column, their columns the one that has to be there as well.
                flat = np.flatnonzero(~(least < most).all(0))
                for other in flat:
                    rows = there[:, other]
                    least[:, other] = np.fmin(least[:, other], np.fmin.reduce(values[rows], 0, initial=np.inf))
                    most[:, other] = np.fmax(most[:, other], np.fmax.reduce(values[rows], 0, initial=-np.inf))
                filled = there.sum(0)
                centre = np.where(there, values, 0.0).sum(0) / np.maximum(filled, 1)
                offset = np.where(there, values - centre, 0.0)
                mask = there.astype(np.float64)
                rows = mask.T @ mask
                some = np.maximum(rows, 1)
                sums = offset.T @ mask
                own = np.where(rows > 0, centre[:, None] + sums / some, 0.0)
                squares = (offset * offset).T @ mask - sums * sums / some
                products = offset.T @ offset - sums * sums.T / some
                total = n + rows
                weight = n * rows / np.maximum(total, 1)
                delta = np.where(weight > 0, own - mean, 0.0)
                cross += products + delta * delta.T * weight
                square += squares + delta * delta * weight
                mean = np.where(n > 0, mean, own) + delta * rows / np.maximum(total, 1)
                n = total
        salt = TaskContext.get().partitionId() % salts
        whole = {"n": n, "cross": cross, "mean": mean, "square": square, "least": least, "most": most}
        for low, high in tiles():
            here, there_ = slice(low * tile, (low + 1) * tile), slice(high * tile, (high + 1) * tile)
            state = {f: whole[f][here, there_] for f in ("n", "cross", "mean", "square", "least", "most")}
            state |= {f"{f}2": whole[f][there_, here].T for f in ("mean", "square", "least", "most")}
            columns_ = [pa.array([x], pa.int32()) for x in (low, high, salt)] + [pa.array([pack(state)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns_, names=["low", "high", "salt", "state"])

    def merged(batches):
        """States of a tile and salt come one after the other."""
        now, held = None, None
        for batch in batches:
            for low, high, salt, raw in zip(*(c.to_pylist() for c in batch.columns)):
                state = unpack(raw, low, high)
                if (low, high, salt) != now:
                    if now is not None:
                        yield now, held
                    now, held = (low, high, salt), state
                else:
                    held = merge(held, state)
        if now is not None:
            yield now, held

    def by_salt(batches):
        import pyarrow as pa

        for (low, high, _), state in merged(batches):
            columns_ = [pa.array([x], pa.int32()) for x in (low, high, 0)] + [pa.array([pack(state)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns_, names=["low", "high", "salt", "state"])

    def coefficients(batches):
        import numpy as np
        import pyarrow as pa

        for (low, high, _), state in merged(batches):
            with np.errstate(all="ignore"):
                spread = state["square"] * state["square2"]
                found = np.clip(state["cross"] / np.sqrt(spread), -1.0, 1.0)
                varies = (state["least"] < state["most"]) & (state["least2"] < state["most2"])
                bounds = (state["least"], state["most"], state["least2"], state["most2"])
                finite = np.logical_and.reduce([np.isfinite(x) for x in bounds])
                found = np.where(varies & finite & (spread > 0) & np.isfinite(found), found, 0.0)
            a = np.repeat(np.arange(found.shape[0]) + low * tile, found.shape[1])
            b = np.tile(np.arange(found.shape[1]) + high * tile, found.shape[0])
            flat = np.where((a == b) & (varies & finite).ravel(), 1.0, found.ravel())
            if low != high:
                a, b, flat = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((flat, flat))
            kinds = (pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip((a, b, flat), kinds)], names=["a", "b", "corr"]
            )

    numbers = df.select(*[number_of(field_of(df.schema, name)).alias(f"c{i}") for i, name in enumerate(columns)])
    # A state without rows, so that an empty table has all its pairs as well.
    empty = df.sparkSession.range(0, 1, 1, 1).mapInArrow(lambda batches: moments(b for b in ()), STATE_SCHEMA)
    states = numbers.mapInArrow(moments, STATE_SCHEMA).unionByName(empty)
    keys = ["low", "high", "salt"]
    salted = states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(by_salt, STATE_SCHEMA)
    final = salted.repartition("low", "high").sortWithinPartitions(*keys)
    pairs = final.mapInArrow(coefficients, "a int, b int, corr double")
    return pairs.withColumn("corr", F.round("corr", digits) + F.lit(0.0))


def _wide(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """The pairs of many columns, block by block."""
    blocks, whole = chunks(list(range(len(columns))), max(1, WIDE // 2)), None
    for number, first in enumerate(blocks):
        for second in blocks[number:]:
            places = first if first is second else first + second
            pairs = pair_correlations(df, [columns[place] for place in places], digits)
            if first is not second:  # pairs within a block have their own turn
                pairs = pairs.where((F.col("a") < len(first)) != (F.col("b") < len(first)))
            place = F.array(*map(F.lit, places))
            part = pairs.select(F.get(place, F.col("a")).alias("a"), F.get(place, F.col("b")).alias("b"), "corr")
            whole = part if whole is None else whole.unionByName(part)
    return whole
