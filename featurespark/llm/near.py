"""Near duplicates: minhash with tensored banding, every link confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import Scratch, column_slices, files_for, join_groups, numbered, once_per_worker, release_others, without_rows
from featurespark.llm.components import components

#: Two collections of so many keys of so many minhashes each; a table is a pair of keys, one of each collection.
#: 2 * 16 * 3 = 96 minhashes serve 256 tables, where as many tables of six own minhashes would need 1,536. A pair
#: with similarity s shares a table unless one collection has no common key: at 0.8 one pair in 50,000 is missed.
KEYS, ROWS = 16, 3

_BITS = np.random.default_rng(20240501)
_FLIP = _BITS.integers(0, 1 << 32, (2 * KEYS * ROWS, 1), dtype=np.uint32)
_SPREAD = _BITS.integers(0, 1 << 32, (2 * KEYS * ROWS, 1), dtype=np.uint32) | np.uint32(1)

#: Shingles hashed at once.
CHUNK = 4_096

#: Nodes of a first key that one group of comparisons takes from each of its two blocks.
BLOCK = 1_024

#: Words whose hashes a worker remembers.
MEMO_WORDS = 250_000

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = once_per_worker("near", dict)
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return np.array([known[w] for w in words], np.uint64)


def shingles(text: str | None, width: int = 2) -> np.ndarray:
    """The sorted set of hashed shingles of `width` words; fewer words are one shingle, no words are none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _word_hashes(words)
    width = min(width, len(words))
    joined = hashes[: len(hashes) - width + 1]
    for i in range(1, width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(mixed(joined + np.uint64(width)))


def keys_of(shingle_set: np.ndarray) -> np.ndarray:
    """The keys of both collections, one after the other."""
    low = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FLIP), 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), CHUNK):
        np.minimum(least, ((low[begin : begin + CHUNK] ^ _FLIP) * _SPREAD).min(1), out=least)
    parts = least.reshape(2 * KEYS, ROWS).astype(np.uint64)
    key = np.arange(2 * KEYS, dtype=np.uint64)
    for part in parts.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key


def _profiles(documents: DataFrame, width: int) -> DataFrame:
    """Per row: size and digest of its set of shingles, and its keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches, 2):
            size, digest, keys = [], [], []
            for text in texts:
                found = shingles(text, width)
                size.append(len(found))
                digest.append(blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(keys_of(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary())],
                ["doc_id", "row", "n_shingles", "digest", "keys"],
            )

    return documents.mapInArrow(task, "doc_id long, row long, n_shingles long, digest binary, keys binary")


def _first_keys(nodes: DataFrame) -> DataFrame:
    """A row for each key of the first collection."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("near keys")
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, 2 * KEYS)[:, :KEYS]
            rows = np.repeat(batch.column(0).to_numpy(), KEYS)
            index = np.tile(np.arange(KEYS, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(index), pa.array(keys.ravel())], ["node", "i", "key"])

    return nodes.select("node", "keys").mapInArrow(task, "node long, i int, key long")


def _tables(nodes: DataFrame) -> DataFrame:
    """A row for each table: pairs of the first keys that are shared with others and all second keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("near keys")
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, 2 * KEYS)
            owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column(2).to_pylist()])
            index = np.array([i for x in batch.column(2).to_pylist() for i in x], np.int64)
            for low in range(0, len(owner), 20_000):
                own, i = owner[low : low + 20_000], index[low : low + 20_000]
                pair = mixed(keys[own, i][:, None] * np.uint64(3) + keys[own][:, KEYS:])
                node, size = (np.repeat(batch.column(c).to_numpy()[own], KEYS) for c in (0, 1))
                first, index_ = np.repeat(keys[own, i].view(np.int64), KEYS), np.repeat(i.astype(np.int32), KEYS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (pair.ravel().view(np.int64), node, size, first, index_)],
                    ["key", "node", "size", "first_key", "i"],
                )

    return nodes.select("node", "size", "shared", "keys").mapInArrow(
        task, "key long, node long, size long, first_key long, i int"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("near keys")
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.sort(np.concatenate((one, two)))
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("right"))
    held = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return held.mapInArrow(task, "u long, v long")


def _across(open_: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among nodes that share a table; `open_` has first_key, i, node and part.

    The nodes of a first key are dealt out to blocks of about BLOCK nodes, and each pair of blocks is one group, so
    that a group is bounded. In a group a node is compared with those that share a table with it, share no earlier
    first key with it (there they meet too), have a fitting size and are still in another component; each link found
    joins two components at once, so that a large group of copies takes about one comparison a node.
    """

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        i, part = int(rows["i"].iloc[0]), rows["part"].to_numpy().copy()
        node, size, block = (rows[c].to_numpy() for c in ("node", "size", "block"))
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint64).reshape(-1, 2 * KEYS)
        members = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        one_block = rows["low"].iloc[0] == rows["high"].iloc[0]
        found = []
        for x in range(1, len(node)):
            able = (part[:x] != part[x]) & (100 * np.minimum(size[:x], size[x]) >= percent * np.maximum(size[:x], size[x]))
            if not one_block:
                able &= block[:x] != block[x]
            near = np.flatnonzero(able)
            near = near[(keys[near, KEYS:] == keys[x, KEYS:]).any(1) & ~(keys[near, :i] == keys[x, :i]).any(1)]
            while len(near):
                y, near = near[0], near[1:]
                both = np.sort(np.concatenate((members[x], members[y])))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    found.append((node[y], node[x]))
                    part[part == part[y]] = part[x]
                    near = near[part[near] != part[x]]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    counts = open_.groupBy("first_key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = open_.join(counts, "first_key").withColumn("block", block).withColumn("other", other)
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    full = dealt.drop("blocks", "other").join(nodes.select("node", "size", "keys"), "node").join(sets, "node")
    return full.groupBy("first_key", "low", "high").applyInPandas(group, "u long, v long")


def _sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The full sets of the rows that take part in a pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches):
            found = [shingles(t, width) for t in texts]
            for members, digest in zip(found, batch.column(2).to_pylist(), strict=True):
                if blake2b(members.tobytes(), digest_size=16).digest() != digest:
                    raise ValueError("the documents were read in another order the second time")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "members"]
            )

    wanted = nodes.select(F.col("node").alias("row"), "digest")
    return rows.join(wanted, "row").select("row", "text", "digest").mapInArrow(task, "node long, members binary")


def near_groups(
    documents: DataFrame, percent: int = 80, width: int = 2, id_column: str = "doc_id", text_column: str = "text",
    row: Column | None = None,
) -> DataFrame:
    """One row per document with the component of documents linked by similar sets of word shingles.

    Two documents are linked when 100 times their common shingles is at least `percent` times all their shingles.
    Columns: doc_id, `row` (number in reading order, or what `row` says), n_shingles, component_id (smallest id of the component), kept
    (the row that stays, the first of the smallest id). Rows with equal sets are one node. Nodes that share a first
    key with another go on to the tables; in each table all are paired with its first node, confirmed on the full
    sets, and joined to components; then nodes of different components that share a table are compared as well, so
    that every pair that shares a table is either confirmed, refuted, or already in one component. Sizes that rule a
    link out end a pair early. No words: no set, a component of its own. Rows with a null id take part in links but
    give no component its name; a component of such rows alone has a null name. The texts are read twice; unless `row`
    numbers them for good, they get numbers that stay, see `numbered`. Other columns are not read; an empty table
    gives no rows.
    """
    work = Scratch(documents.sparkSession)
    if row is None:
        documents, name = numbered(documents.select(id_column, text_column))
        row = F.col(name)
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), row.alias("row"),
        F.col(text_column).alias("text"),
    )
    profiles = work.table(_profiles(rows, width), "profiles")
    total = profiles.count()
    filled = profiles.filter("n_shingles > 0")
    groups = filled.groupBy("digest").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"),
    )
    groups = work.table(groups.coalesce(files_for(total)), "groups")
    nodes = filled.join(groups.select(F.col("node").alias("row"), "first"), "row").select(
        F.col("row").alias("node"), F.col("n_shingles").alias("size"), "digest", "keys"
    )
    nodes = work.table(nodes, "nodes")
    keys = _first_keys(nodes)
    shared = keys.join(keys.groupBy("key").count().filter("count > 1"), "key", "left_semi")
    owners = shared.groupBy("node").agg(F.collect_list("i").alias("shared"))
    members = _tables(nodes.join(owners, "node"))
    buckets = members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("lead"), F.count("*").alias("n"))
    members = members.join(buckets.filter("n > 1").select("key", "lead"), "key")
    members = work.table(members, "members")
    pair_files = files_for(members.count())
    fits = "100 * least(u_size, v_size) >= {0} * greatest(u_size, v_size)".format(percent)
    stars = members.filter("node <> lead.node").select(
        F.col("lead.node").alias("u"), F.col("node").alias("v"), F.col("lead.size").alias("u_size"), F.col("size").alias("v_size")
    )
    stars = work.table(stars.filter(fits).select("u", "v").distinct().coalesce(pair_files), "stars")
    sets = _sets(rows, nodes.join(members.select("node").distinct(), "node"), width)
    sets = work.table(sets, "sets")
    links = work.table(_confirmed(stars, sets, percent), "links")
    first = components(links)
    placed = members.join(first, "node", "left").withColumn("part", F.coalesce("component", "node"))
    placed = work.table(placed.select("key", "first_key", "i", "node", "part"), "placed")
    mixed_keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    open_ = placed.join(mixed_keys.select("key"), "key", "left_semi").select("first_key", "i", "node", "part").distinct()
    later = _across(work.table(open_.coalesce(pair_files), "open"), nodes, sets, percent)
    final = components(links.unionByName(later))
    named = groups.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("component").agg(F.min("first").alias("lead"))
    named = work.table(named.join(parts, "component").select("digest", "copies", "lead").coalesce(files_for(total)), "named")
    joined = join_groups(filled.select("doc_id", "row", "n_shingles", "digest"), named, "digest", "copies", total)
    linked = joined.select(
        "doc_id", "row", "n_shingles", F.col("lead.doc_id").alias("component_id"), (F.col("row") == F.col("lead.row")).alias("kept")
    )
    empty = profiles.filter("n_shingles = 0").select(
        "doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return work.result(linked.unionByName(empty).coalesce(files_for(total)), "near")


def drop_near_copies(documents: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """The first document of each component, with all its columns, whatever their names.

    Null texts and texts without a word stay; of repeated rows the first stays; rows with a null id take part; an
    empty table stays empty.
    """
    held, row = numbered(documents)
    return without_rows(held, row, near_groups(held, percent, width, row=F.col(row)).filter("not kept").select("row"))
