"""Nearest neighbours by learned partitions: a neighbour graph is cut in balanced parts, a classifier routes to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.common import work_table

#: Vectors that graph and classifier are fitted on, the first by a hash of their id, and neighbours in the graph.
SAMPLE, NEIGHBOURS = 4_000, 10

#: Sample vectors of one part; with the size of the sample this bounds the number of parts.
PART_SAMPLE = 125

#: The part of a sample vector's graph neighbours that the routed parts must hold, on average.
LEAST_FOUND = 0.96

#: Rows of one part, and queries, that are compared in one task at a time.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000

#: Candidates whose distance is computed exactly at a time.
EXACT_ROWS = 4_096


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by products; accurate enough to choose candidates."""
    return (left * left).sum(1)[:, None] + (right * right).sum(1) - 2 * left @ right.T


def in_reach(left: np.ndarray, right: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Which of `right` may be among the k nearest of each of `left`, all that are as far as the k-th included.

    `far` has the distances by products, infinite where a row is no candidate. They are off by rounding: at most by
    `slack`, several times the bound for sums of that many products. k rows are surely within the k-th smallest of
    far + slack, so a row can be left out only if far - slack is above that.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (left * left).sum(1)[:, None] + (right * right).sum(1)
        slack = (8 * left.shape[1] + 32) * np.finfo(np.float64).eps * norms + np.finfo(np.float64).tiny
        above, below = far + slack, far - slack
    above[np.isnan(above)], below[np.isnan(below)] = np.inf, -np.inf
    if k < above.shape[1]:
        above.partition(k - 1, 1)
        below = below <= above[:, k - 1 : k]
        return below
    return np.ones(far.shape, bool)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector."""
    out = np.empty((len(vectors), min(k, len(vectors) - 1)), np.int64)
    for begin in range(0, len(vectors), 500):
        far = distances(vectors[begin : begin + 500], vectors)
        far[np.arange(len(far)), np.arange(begin, begin + len(far))] = np.inf
        out[begin : begin + 500] = np.argpartition(far, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of equal size with few cut edges: halves along the main axis, improved by swapping pairs, again and again."""
    label = np.zeros(len(vectors), np.int64)
    work = [(np.arange(len(vectors)), 0, parts)]
    while work:
        rows, first, count = work.pop()
        if count == 1:
            label[rows] = first
            continue
        centred = vectors[rows] - vectors[rows].mean(0)
        axis = np.linalg.svd(centred[:1000], full_matrices=False)[2][0] if len(rows) > 1 else centred[0]
        side = np.zeros(len(rows), bool)
        side[np.argsort(centred @ axis, kind="stable")[len(rows) * (count // 2) // count :]] = True
        place = np.full(len(vectors), -1)
        place[rows] = np.arange(len(rows))
        own, other = np.repeat(np.arange(len(rows)), graph.shape[1]), place[graph[rows]].ravel()
        inside = other >= 0
        own, other = np.concatenate((own[inside], other[inside])), np.concatenate((other[inside], own[inside]))
        for _ in range(rounds):
            cut = side[own] != side[other]
            gain = np.bincount(own, np.where(cut, 1, -1), len(rows))
            left, right = np.flatnonzero(~side), np.flatnonzero(side)
            left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
            n = min(len(left), len(right))
            swaps = int((gain[left[:n]] + gain[right[:n]] > 1).sum()) // 2
            if not swaps:
                break
            before = cut.sum()
            side[left[:swaps]], side[right[:swaps]] = True, False
            if (side[own] != side[other]).sum() >= before:
                side[left[:swaps]], side[right[:swaps]] = False, True
                break
        work += [(rows[~side], first, count // 2), (rows[side], first + count // 2, count - count // 2)]
    return label


class Router:
    """A network with one hidden layer that gives the probability of each part."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays

    def _hidden(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum((vectors - self.arrays["mean"]) / self.arrays["scale"] @ self.arrays["in"] + self.arrays["shift"], 0)

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        scores = self._hidden(vectors) @ self.arrays["out"] + self.arrays["bias"]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def routed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) for the most probable parts of each vector, up to the probability learned."""
        found = self.probabilities(vectors)
        order = np.argsort(-found, 1, kind="stable")
        before = np.cumsum(np.take_along_axis(found, order, 1), 1) - np.take_along_axis(found, order, 1)
        taken = before < self.arrays["mass"]
        return np.nonzero(taken)[0], order[taken]

    @classmethod
    def fit(cls, vectors: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30) -> Router:
        """Learn the parts of a sample: each vector's own part and those of its graph neighbours, as shares."""
        random = np.random.default_rng(17)
        width = vectors.shape[1] if len(vectors) else 1
        arrays = {
            "mean": vectors.mean(0) if len(vectors) else np.zeros(width),
            "scale": np.full(width, max(float(vectors.std()), 1e-9) if len(vectors) else 1.0),
            "in": random.standard_normal((width, hidden)) * (2 / width) ** 0.5,
            "shift": np.zeros(hidden), "out": random.standard_normal((hidden, parts)) * hidden**-0.5,
            "bias": np.zeros(parts), "mass": np.array(1.0),
        }
        router = cls(arrays)
        if parts < 2:
            return router
        graph = neighbour_graph(vectors, NEIGHBOURS)
        label = balanced_parts(vectors, graph, parts)
        share = np.zeros((len(vectors), parts))
        np.add.at(share, (np.repeat(np.arange(len(vectors)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
        target = 0.5 * share
        target[np.arange(len(vectors)), label] += 0.5
        names = ("in", "shift", "out", "bias")
        mean, square, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(vectors)), max(1, len(vectors) // 128)):
                x, step = (vectors[rows] - arrays["mean"]) / arrays["scale"], step + 1
                layer = router._hidden(vectors[rows])
                error = (router.probabilities(vectors[rows]) - target[rows]) / len(rows)
                down = (error @ arrays["out"].T) * (layer > 0)
                for k, g in (("out", layer.T @ error), ("bias", error.sum(0)), ("in", x.T @ down), ("shift", down.sum(0))):
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    arrays[k] -= 0.003 * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        home = router.probabilities(vectors).argmax(1)
        found = router.probabilities(vectors)
        order = np.argsort(-found, 1, kind="stable")
        rank = np.argsort(order, 1)
        before = np.cumsum(np.take_along_axis(found, order, 1), 1) - np.take_along_axis(found, order, 1)
        needed = np.take_along_axis(before, np.take_along_axis(rank, home[graph], 1), 1)
        arrays["mass"] = np.array(min(1.0, float(np.quantile(needed, LEAST_FOUND)) + 1e-9))
        return router


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: an id, no null or non-finite component, not all zero, and of the most frequent length."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & whole)
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (sizes["n"] if sizes else 0))


def _table(vectors: pa.Array | pd.Series) -> np.ndarray:
    values = vectors.to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else vectors.to_numpy()
    return np.stack(values).astype(np.float64)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest other vectors of each vector whose id is divisible by `every`: query_id, rank, vec_id, score.

    A sample of bounded size teaches the parts; then every vector is filed under its most probable part and every
    query looks into the parts that together have the learned probability, the same for all. Parts and queries are
    compared in blocks, so that a part with a third of all rows is spread over many tasks; in each block all rows that
    may be as near as the k-th nearest are ordered by distance (double precision, on the vectors as given) and id, and
    the first k are sent and ranked the same way, so that of equally far rows those with smaller ids stay. Rows with the
    query's own id are no candidates. With fewer than two samples a part there is one part, so that small tables are
    searched whole; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = work_table(usable(vectors), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    table = np.array([r.vector for r in sample], np.float64)
    router = Router.fit(table, max(1, len(table) // PART_SAMPLE) if len(table) > 2 * PART_SAMPLE else 1)
    held = spark.sparkContext.broadcast(router.arrays)

    def file_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Router(held.value)
        for batch in batches:
            if batch.num_rows:
                part = own.probabilities(_table(batch.column(1))).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], ["vec_id", "vector", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Router(held.value)
        for batch in batches:
            if batch.num_rows:
                row, part = own.routed(_table(batch.column(1)))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(part.astype(np.int32))], ["vec_id", "vector", "part"]
                )

    schema = "vec_id long, vector array<double>, part int"
    filed = work_table(rows.mapInArrow(file_, schema), "filed")
    queries = work_table(rows.filter(F.col("vec_id") % every == 0).mapInArrow(route, schema), "queries")
    sizes = filed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("slots"))
    plan = F.broadcast(sizes.join(asked, "part"))
    number = F.xxhash64("vec_id", F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(plan, "part").withColumn("block", F.pmod(number, "blocks").cast("int")).withColumn("slot", each("slots"))
    right = queries.join(plan, "part").withColumn("slot", F.pmod(number, "slots").cast("int")).withColumn("block", each("blocks"))

    def compare(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asking):
            ids, those = candidates["vec_id"].to_numpy(), _table(candidates["vector"])
            names, these = asking["vec_id"].to_numpy(), _table(asking["vector"])
            for begin in range(0, len(these), 128):
                name, block = names[begin : begin + 128], these[begin : begin + 128]
                far = distances(block, those)
                far[name[:, None] == ids] = np.inf
                close = in_reach(block, those, far, k)
                for q, vector, may in zip(name.tolist(), block, close, strict=True):
                    row = np.flatnonzero(may & (ids != q))
                    parts = np.split(row, range(EXACT_ROWS, len(row), EXACT_ROWS))
                    score = np.concatenate([np.sqrt(((those[x] - vector) ** 2).sum(1)) for x in parts])
                    first = np.lexsort((ids[row], score))[:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[row[first]], "score": score[first]}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(out)

    keys = ["part", "block", "slot"]
    one, two = (d.select("vec_id", "vector", *keys).groupBy(*keys) for d in (left, right))
    found = one.cogroup(two).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
