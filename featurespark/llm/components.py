"""Connected components of a graph held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import Scratch, files_for


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.union(least).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (u, v) with long ends; a component is named by its smallest node.

    Alternating star contractions: neighbours are pointed at the smallest node in reach until nothing changes, in a
    number of rounds that grows with the logarithm of the longest path. Each round is written to the shared folder, in
    files that follow the number of edges, which no round raises.
    Loops, repeated and reversed edges do no harm; null ends are left out; no edges give no rows.
    """
    work = Scratch(edges.sparkSession)
    edges = edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct()
    edges = work.table(edges, "edges")
    state, files = None, files_for(edges.count())
    while True:
        edges = work.table(_small_star(_large_star(edges)).coalesce(files), "edges")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == state or not mark[0]:
            break
        state = mark
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return work.result(named.coalesce(2 * files), "components")
