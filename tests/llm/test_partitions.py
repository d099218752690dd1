"""Learned partitions against brute force."""

import numpy as np
from pyspark.sql import functions as F

from featurespark.llm import partitions


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int").repartition(3)


def brute(rows, k=10, every=100):
    known = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in known:
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in known if j != i)
            out[i] = near[:k]
    return out


def clustered(n, seed):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((12, 8)) * 4
    return [(i, (centres[i % 12] + random.standard_normal(8)).tolist(), 0) for i in range(n)]


def test_small_tables_are_exact(spark):
    rows = clustered(220, 1)
    rows += [(300, None, 0), (400, [0.0] * 8, 0), (500, [float("nan")] * 8, 0), (600, [None] * 8, 0), (None, [1.0] * 8, 0), (700, [1.0], 0), (800, rows[0][1], 0)]
    found = {}
    for r in partitions.nearest(table(spark, rows)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows)
    assert set(found) == set(want)
    for key, near in want.items():
        assert [(s, j) for _, s, j in sorted(found[key])] == near
        assert [x for x, _, _ in sorted(found[key])] == list(range(1, 11))


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(partitions, "BLOCK_ROWS", 300)
    monkeypatch.setattr(partitions, "BLOCK_QUERIES", 7)
    rows = clustered(3000, 2)
    hits = total = 0
    found = {}
    for r in partitions.nearest(table(spark, rows), every=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for key, near in brute(rows, every=50).items():
        hits += len({j for _, j in near} & found[key])
        total += len(near)
    assert hits / total >= 0.9


def test_recall_beyond_the_sample(spark):
    """Three of four rows are not in the sample that the parts and the router were learned from."""
    rows = clustered(4 * partitions.SAMPLE, 9)
    found = {}
    for r in partitions.nearest(table(spark, rows), every=400).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, every=400)
    hits = sum(len({j for _, j in near} & found[key]) for key, near in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_copies_and_close_vectors_far_from_zero_are_exact(spark):
    random = np.random.default_rng(5)
    for rows in (
        [(i, [1.0] * 8 if i % 6 else [1.0 + i] * 8, 0) for i in range(240)],
        [(i, (4e6 + random.integers(0, 9, 8) * 0.25).tolist(), 0) for i in range(240)],
    ):
        found = {}
        for r in partitions.nearest(table(spark, [rows[i] for i in random.permutation(240)]), every=20).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert {q: [(s, j) for _, s, j in sorted(near)] for q, near in found.items()} == brute(rows, every=20)


def test_few_and_no_vectors(spark):
    few = table(spark, [(0, [1.0] * 8, 0), (1, [2.0] * 8, 0)])
    assert [tuple(r)[:3] for r in partitions.nearest(few).collect()] == [(0, 1, 1)]
    assert partitions.nearest(few.filter("false")).count() == 0


def test_parts_are_balanced_and_cut_few_edges():
    vectors = np.array([v for _, v, _ in clustered(1200, 3)])
    graph = partitions.neighbour_graph(vectors, 10)
    label = partitions.balanced_parts(vectors, graph, 6)
    assert np.bincount(label).tolist() == [200] * 6
    assert (label[graph] == label[:, None]).mean() > 0.7
