"""Prefix trie of conversations by bursting: containers of suffixes under heads, split while large, then swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import Scratch

#: Bytes of the id of a turn, the first ones of a SHA-256.
ID_BYTES = 16

#: A container with more turns than this bursts; for large tables it may hold total / MOST_HEADS turns, so that at
#: most so many heads burst in a round and their list can be broadcast.
CONTAINER_TURNS, MOST_HEADS = 20_000, 200_000

#: Consecutive ids whose decimals are joined before they meet the others of their end.
ENDS_BITS = 12

NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, head binary, parent binary"
)


def _turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; the length of the role keeps role and text apart."""
    joined = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 2 * ID_BYTES)


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, `ids`, `chars`): each conversation after its first turns were replaced by those of its hundred's first.

    Conversation c begins with the first h turns of conversation c - c % 100 (fewer, if it has fewer or is missing)
    instead of its own first h, h being crc32 of the decimal c, modulo 6. `ids` holds ID_BYTES bytes a turn, `chars`
    the code points of each text. Turns are taken by number, null first, then by their ids; repeated rows are repeated
    turns, null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_id(role, text).alias("id"), F.char_length(text).alias("chars")
    ).filter("conv_id is not null")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("own"))
    whole = whole.select(
        "conv_id", F.transform("own", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("own")
    )
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    firsts = whole.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 5).alias("first"))
    rows = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(firsts, "base", "left")
    rows = rows.withColumn("h", borrowed.cast("int"))
    nothing = F.slice("own", 1, F.lit(0))
    begin = F.coalesce(F.slice("first", F.lit(1), F.col("h")), nothing)
    rest = F.slice("own", F.col("h") + 1, F.size("own"))
    turns = F.concat(begin, rest)
    return rows.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), "")).alias("ids"),
        F.transform("turns", lambda x: x["chars"]).alias("chars"),
    )


def _ends(rebuilt: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ascending decimal ids of equal conversations, for groups of two or more.

    Ids are joined in runs of near numbers first, so that what meets in the task that hashes a large group is a
    stream of long strings.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, out = None, None, []
        for batch in batches:
            for key, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256(run.encode())
                else:
                    running.update(b"," + run.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["key", "ends"])

    run = F.shiftright("conv_id", ENDS_BITS).alias("run")
    listed = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    runs = rebuilt.groupBy("key", run).agg(F.array_join(listed, ",").alias("decimals"))
    dealt = runs.repartition("key").sortWithinPartitions("key", "run")
    return dealt.select("key", "decimals").mapInArrow(task, "key binary, ends string")


def _suffixes(rebuilt: DataFrame, work: Scratch) -> DataFrame:
    """One row for each distinct conversation below the root: its turns, members, smallest member and digest of ends."""
    keyed = work.table(rebuilt.withColumn("key", F.unhex(F.md5("ids"))), "rebuilt")
    merged = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("ids").alias("ids"), F.first("chars").alias("chars")
    )
    merged = work.table(merged, "merged")
    many = keyed.select("key", "conv_id").join(merged.filter("n > 1").select("key"), "key", "left_semi")
    ends = F.coalesce("ends", F.sha2(F.col("least").cast("string").cast("binary"), 256)).alias("ends")
    root = F.lit(b"").alias("head")
    return merged.join(_ends(many), "key", "left").select(
        root, F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("last_chars"),
        "ids", "chars", "n", "least", ends,
    )


class _Sweep:
    """Nodes of one container from its suffixes in order: the path to the last suffix is open, all else is done."""

    def __init__(self, head: bytes, parent: bytes | None, depth: int, chars: int) -> None:
        self._head, self._parent, self._depth = head, parent, depth
        self._path = [self._node(b"", chars)]

    @staticmethod
    def _node(turn: bytes, chars: int) -> dict:
        return {"turn": turn, "chars": chars, "n": 0, "least": None, "children": [], "leaves": 0, "saved": 0, "ends": NO_ENDS}

    def add(self, ids: bytes, chars: list[int], n: int, least: int, ends: str) -> Iterator[tuple]:
        turns = [ids[i : i + ID_BYTES] for i in range(0, len(ids), ID_BYTES)]
        same = 0
        while same < min(len(turns), len(self._path) - 1) and turns[same] == self._path[same + 1]["turn"]:
            same += 1
        while len(self._path) > same + 1:
            yield from self._pop()
        self._path += [self._node(t, c) for t, c in zip(turns[same:], chars[same:], strict=True)]
        self._count(self._path[-1], n, least)
        self._path[-1]["ends"] = ends

    @staticmethod
    def _count(node: dict, n: int, least: int) -> None:
        node["n"] += n
        node["least"] = least if node["least"] is None else min(least, node["least"])

    def _row(self, node: dict, depth: int) -> tuple:
        return depth, node["n"], len(node["children"]), node["leaves"], node["saved"], node["ends"]

    def _pop(self) -> Iterator[tuple]:
        """Close the last node of the path: its children are given out, as its smallest member is known now."""
        depth, node = self._depth + len(self._path) - 1, self._path.pop()
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["chars"]
        for least, (at, n, *rest) in node["children"]:
            yield (least, at, node["least"], n, *rest, None, None)
        row = self._row(node, depth)
        if self._path:
            above = self._path[-1]
            self._count(above, node["n"], node["least"])
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
            above["children"].append((node["least"], row))
        else:
            yield (node["least"], row[0], None, *row[1:], self._head, self._parent)

    def finish(self) -> Iterator[tuple]:
        while self._path:
            yield from self._pop()


def _swept(containers: DataFrame) -> DataFrame:
    """All nodes of the containers; the node of a head carries `head` and `parent`, its parent is not known yet."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
        now, sweep, out = None, None, []
        for batch in batches:
            for head, parent, depth, last, ids, chars, n, least, ends in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if head != now:
                    if sweep:
                        out += sweep.finish()
                    now, sweep = head, _Sweep(head, parent, depth, last)
                out += sweep.add(ids, chars, n, least, ends)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)
                out = []
        if sweep:
            out = list(sweep.finish())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    dealt = containers.repartition("head").sortWithinPartitions("head", "ids")
    columns = ["head", "parent", "depth", "last_chars", "ids", "chars", "n", "least", "ends"]
    return dealt.select(*columns).mapInArrow(task, NODE_SCHEMA)


def _burst(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes of bursting heads dealt out to the heads of their next turns, and those that end at a head."""
    turn = F.substring("ids", 1, ID_BYTES)
    rest = F.expr(f"substring(ids, {ID_BYTES + 1}, octet_length(ids))")
    below = rows.filter("octet_length(ids) > 0").select(
        F.unhex(F.md5(F.concat("head", turn))).alias("head"), F.col("head").alias("parent"),
        F.get("chars", F.lit(0)).cast("long").alias("last_chars"), rest.alias("ids"),
        F.slice("chars", F.lit(2), F.size("chars")).alias("chars"), "n", "least", "ends", F.lit(depth + 1).cast("long").alias("depth"),
    )
    stops = rows.filter("octet_length(ids) = 0").select("head", "n", "least", "ends")
    return below, stops


def _above(below: DataFrame, stops: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """The nodes of burst heads from the nodes under them and the conversations that end there."""
    sums = below.groupBy(F.col("parent").alias("head")).agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.count("*").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"),
    )
    own = stops.select("head", F.col("n").alias("own_n"), F.col("least").alias("own_least"), "ends")
    joined = heads.join(sums, "head", "left").join(own, "head", "left")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("own_n", F.lit(0))
    return joined.select(
        F.least("least", "own_least").alias("conv_id"), F.lit(depth).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), n.alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (n - 1) * F.col("last_chars")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "head", "parent",
    )


def prefix_trie(sequences: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the prefix trie of `sequences` (conv_id, ids, chars).

    Equal sequences are merged first and count as many members. The root always bursts; then, round after round, every
    container (the suffixes under one head) with more than `container_turns` turns is burst by the id of its next
    turn, and its head becomes an inner node. The others are sorted and swept, each in one streaming pass that holds
    one path. Burst heads get their sums from the nodes below, deepest first. The number of rounds is the depth of the
    deepest prefix that many distinct sequences share; a sequence is one row, ID_BYTES + 4 bytes a turn.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. An empty table has no nodes; sequences without a turn are members of the root alone.
    """
    spark = sequences.sparkSession
    work = Scratch(spark)
    rows = work.table(_suffixes(sequences, work).withColumn("depth", F.lit(0).cast("long")), "suffixes")
    total = rows.agg(F.sum(F.size("chars")), F.count("*")).first()
    if not total[1]:
        return spark.createDataFrame([], NODE_SCHEMA).drop("head", "parent")
    most = max(container_turns, (total[0] or 0) // MOST_HEADS)
    closed, rounds, depth = [], [], 0
    while True:
        sizes = rows.groupBy("head").agg(
            F.sum(F.size("chars") + 1).alias("size"), F.first("parent").alias("parent"), F.first("last_chars").alias("last_chars")
        )
        large = sizes if not depth else sizes.filter(F.col("size") > most)
        heads = work.table(large.select("head", "parent", "last_chars"), "heads")
        if not heads.take(1):
            closed.append(rows)
            break
        listed = F.broadcast(heads.select("head"))
        if depth:
            closed.append(rows.join(listed, "head", "left_anti"))
            bursting = rows.join(listed, "head", "left_semi")
        else:
            bursting = rows
        below, stops = _burst(bursting, depth)
        rounds.append((heads, work.table(stops, "stops")))
        rows, depth = work.table(below, "below"), depth + 1
    containers = closed[0]
    for part in closed[1:]:
        containers = containers.unionByName(part)
    swept = work.table(_swept(containers), "swept")
    tops = swept.filter("head is not null")
    inner, below = [], None
    for depth in reversed(range(len(rounds))):
        heads, stops = rounds[depth]
        here = tops.filter(F.col("depth") == depth + 1)
        below = here if below is None else here.unionByName(below)
        below = work.table(_above(below, stops, heads, depth), "inner")
        inner.append(below)
    burst = inner[0]
    for part in inner[1:]:
        burst = burst.unionByName(part)
    named = F.broadcast(burst.select(F.col("head").alias("parent"), F.col("conv_id").alias("above")))
    upper = tops.unionByName(burst).join(named, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    nodes = swept.filter("head is null").unionByName(upper.select(*swept.columns))
    return work.result(nodes.drop("head", "parent"), "nodes")
