"""One mergeable state per column from one read: counts, size, range, moments, a quantile sketch, distinct registers.

A task folds its rows into one state per column; the states of a column are merged within salted groups of
tasks and then over the groups. Moments are kept around the mean, and the mean as a distance from one of the
values, so that neither many rows nor a distant origin costs digits. The quantile sketch halves sorted buffers:
what it says of a rank is wrong by a small part of all rows, and it is exact while no buffer was halved.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a buffer of a task's sketch may hold before it is halved; merged states have larger buffers.
BUFFER, MERGED_BUFFER = 512, 4_096

#: Groups of tasks whose states are merged first.
SALTS = 64

#: Bits that choose one of the registers for distinct counts.
REGISTER_BITS = 14

STATE_SCHEMA = "column int, salt int, state binary"


@dataclass
class ColumnState:
    """What is known of a column. Moments leave infinite values out; `levels[i]` holds values of weight 2**i."""

    rows: int = 0
    filled: int = 0
    size: int = 0
    least: float = math.inf
    most: float = -math.inf
    finite: int = 0
    shift: float = 0.0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0
    levels: list = field(default_factory=list)
    registers: object = None

    @property
    def average(self) -> float | None:
        """The mean of all values, infinite where they make it so."""
        if not self.filled:
            return None
        if math.isinf(self.least) or math.isinf(self.most):
            return self.least + self.most
        return min(max(self.shift + self.mean, self.least), self.most)

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """The values of the sketch in order, and how many rows each stands for."""
        values = np.concatenate([np.asarray(x) for x in self.levels]) if self.levels else np.zeros(0)
        weight = np.concatenate([np.full(len(x), 2**i) for i, x in enumerate(self.levels)]) if self.levels else np.zeros(0)
        order = np.argsort(values, kind="stable")
        return values[order], weight[order].astype(np.int64)

    @property
    def lossless(self) -> bool:
        return not any(len(x) for x in self.levels[1:])

    def distinct(self) -> int:
        """Estimate from the registers: the mean of powers, by empty registers where few values were seen."""
        held = np.asarray(self.registers, np.float64)
        m, empty = len(held), int((held == 0).sum())
        estimate = 0.7213 / (1 + 1.079 / m) * m * m / np.power(2.0, -held).sum()
        if estimate <= 2.5 * m and empty:
            estimate = m * math.log(m / empty)
        return round(estimate)


def _folding(buffer: int, merged_buffer: int, bits: int):
    """Functions on states as dictionaries, nested so that they travel to the workers by value."""

    def empty():
        import math

        return {"rows": 0, "filled": 0, "size": 0, "least": math.inf, "most": -math.inf, "finite": 0, "shift": 0.0,
                "mean": 0.0, "m2": 0.0, "m3": 0.0, "m4": 0.0, "levels": [], "registers": None}

    def add_moments(state, n, shift, mean, m2, m3, m4):
        if not n:
            return
        if not state["finite"]:
            state.update(finite=n, shift=shift, mean=mean, m2=m2, m3=m3, m4=m4)
            return
        a, b = state["finite"], n
        total = a + b
        step = (shift - state["shift"]) + (mean - state["mean"])
        state["m4"] += (
            m4 + step**4 * a * b * (a * a - a * b + b * b) / total**3
            + 6 * step**2 * (a * a * m2 + b * b * state["m2"]) / total**2
            + 4 * step * (a * m3 - b * state["m3"]) / total
        )
        state["m3"] += m3 + step**3 * a * b * (a - b) / total**2 + 3 * step * (a * m2 - b * state["m2"]) / total
        state["m2"] += m2 + step * step * a * b / total
        state["mean"] += step * b / total
        state["finite"] = total

    def add_values(levels, level, values, most):
        """Put values of weight 2**level into their buffer; a full one is sorted and every second value moves up."""
        import numpy as np

        while len(levels) <= level:
            levels.append(np.zeros(0))
        held = np.concatenate((levels[level], values))
        if len(held) <= most:
            levels[level] = held
            return
        held.sort()
        rest = len(held) % 2
        # Which half moves changes from one time to the next, so that errors cancel.
        odd = int(held.view(np.uint64).sum() >> np.uint64(3)) & 1
        levels[level], held = held[len(held) - rest :], held[: len(held) - rest]
        add_values(levels, level + 1, held[odd::2], most)

    def merge(one, two):
        import numpy as np

        for name in ("rows", "filled", "size"):
            one[name] += two[name]
        one["least"], one["most"] = min(one["least"], two["least"]), max(one["most"], two["most"])
        add_moments(one, *(two[name] for name in ("finite", "shift", "mean", "m2", "m3", "m4")))
        for level, values in enumerate(two["levels"]):
            if len(values):
                add_values(one["levels"], level, values, merged_buffer)
        if two["registers"] is not None:
            held = one["registers"]
            one["registers"] = two["registers"] if held is None else np.maximum(held, two["registers"])
        return one

    def fold_numbers(state, values):
        import numpy as np

        there = values[~np.isnan(values)]
        state["filled"] += len(there)
        if not len(there):
            return
        state["least"], state["most"] = min(state["least"], float(there.min())), max(state["most"], float(there.max()))
        add_values(state["levels"], 0, there, buffer)
        finite = there[np.isfinite(there)]
        if len(finite):
            shift = state["shift"] if state["finite"] else float(finite[0])
            with np.errstate(all="ignore"):
                offset = finite - shift
                mean = float(offset.mean())
                offset = offset - mean
                square = offset * offset
                sums = [float(x.sum()) for x in (square, square * offset, square * square)]
            add_moments(state, len(finite), shift, mean, *sums)

    def fold_hashes(state, hashes):
        import numpy as np

        if state["registers"] is None:
            state["registers"] = np.zeros(1 << bits, np.uint8)
        hashes = hashes.astype(np.uint64)
        place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        rest = (hashes << np.uint64(bits)) | np.uint64(1 << (bits - 1))
        # The first set bit: 64 minus the length of the number, by its exponent as a double.
        first = (64 - np.frexp(rest.astype(np.float64))[1] + 1).clip(1, 64 - bits + 1).astype(np.uint8)
        np.maximum.at(state["registers"], place, first)

    return empty, merge, fold_numbers, fold_hashes


def column_states(
    df: DataFrame, numbers: Mapping[str, Column], sizes: Mapping[str, Column], hashes: Mapping[str, Column] | None = None
) -> dict[str, ColumnState]:
    """States of the columns named in `numbers` (a double, missing values null) and in `sizes` (bytes of a value,
    null where it is missing). `hashes` (64 bits of a value, null where it is missing) asks for distinct counts."""
    hashes = hashes or {}
    names = [*numbers, *sizes]
    kinds = ["number"] * len(numbers) + ["size"] * len(sizes) + ["hash"] * len(hashes)
    place = [*range(len(names)), *(names.index(name) for name in hashes)]
    columns = [*numbers.values(), *sizes.values(), *hashes.values()]
    if not columns:
        return {}
    empty, merge, fold_numbers, fold_hashes = _folding(BUFFER, MERGED_BUFFER, REGISTER_BITS)
    salts, count = SALTS, len(names)

    def packed(states):
        import pickle

        import pyarrow as pa

        rows = [(column, salt, pickle.dumps(state, protocol=5)) for (column, salt), state in states]
        if rows:
            kinds_ = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds_)], names=["column", "salt", "state"]
            )

    def fold(batches):
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        states = [empty() for _ in range(count)]
        for batch in batches:
            for column, kind, at in zip(batch.columns, kinds, place):
                state = states[at]
                if kind == "number":
                    state["rows"] += batch.num_rows
                    fold_numbers(state, column.to_numpy(zero_copy_only=False).astype(np.float64))
                elif kind == "size":
                    state["rows"] += batch.num_rows
                    state["filled"] += batch.num_rows - column.null_count
                    state["size"] += pc.sum(column).as_py() or 0
                else:
                    fold_hashes(state, column.drop_null().to_numpy())
        salt = TaskContext.get().partitionId() % salts
        yield from packed(((column, salt), state) for column, state in enumerate(states))

    def merged(batches):
        import pickle

        now, held = None, None
        for batch in batches:
            for column, salt, raw in zip(*(c.to_pylist() for c in batch.columns)):
                state = pickle.loads(raw)
                if now == (column, salt):
                    held = merge(held, state)
                    continue
                if now is not None:
                    yield from packed([(now, held)])
                now, held = (column, salt), merge(empty(), state)
        if now is not None:
            yield from packed([(now, held)])

    keys = ["column", "salt"]
    states = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(fold, STATE_SCHEMA)
    salted = states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, STATE_SCHEMA)
    # At most SALTS states per column reach the driver.
    result: dict[str, dict] = {name: empty() for name in names}
    for row in sorted(salted.collect(), key=lambda r: (r["column"], r["salt"])):
        merge(result[names[row["column"]]], pickle.loads(row["state"]))
    return {name: ColumnState(**state) for name, state in result.items()}


def ranks_of(state: ColumnState, ranks: Iterable[int]) -> list[float]:
    """The values that the sketch has at the given ranks; exact for a lossless one."""
    values, weight = state.weighted()
    upto = np.cumsum(weight)
    scale = upto[-1] / state.filled if state.filled else 1.0
    return [float(values[min(int(np.searchsorted(upto, rank * scale, "right")), len(values) - 1)]) for rank in ranks]
