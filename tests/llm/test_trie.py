"""The conversation trie against a trie of dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from featurespark.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])  # -3 % 100 is -3, as in SQL
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(nodes[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(m), len(node), min(nodes[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == node).encode()).hexdigest(),
        )
        for node, m in nodes.items()
    )


def plain(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def some(seed, n=60):
    """Conversations of the same few turns, copies, one long one, and rows with nulls, repeated turns and repeated rows."""
    draw = random.Random(seed)
    rows = []
    for c in [*range(n), *range(300, 300 + n // 2), 505, -3]:
        length = 14 if c == 7 else draw.randrange(1, 9)
        rows += [(c, i, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "é😀c"])) for i in range(length)]
    rows += [(c, i, "user", "copy") for c in range(1000, 1040) for i in range(7)]
    rows += [(600, None, "user", "x"), (600, 1, None, None), (600, 1, "", ""), (600, 1, "user", "tie"), (600, 2, "u", "y")]
    rows += [(601, 0, "user", "x")] * 3 + [(None, 0, "user", "lost")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "turns"), [(1, 1), (2, 12), (3, 10_000)])
def test_every_node(spark, seed, turns):
    rows = some(seed)
    found = trie.prefix_trie(trie.rebuilt_conversations(spark.createDataFrame(rows, SCHEMA)), turns)
    assert plain(found) == brute(rows)


def test_negative_ids_and_runs_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "ENDS_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-30, 900)]
    found = trie.prefix_trie(trie.rebuilt_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert plain(found) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert trie.prefix_trie(trie.rebuilt_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = some(5, 10)
    wide = spark.createDataFrame([(*r, b"h", "k", 1) for r in rows], SCHEMA + ", head binary, key string, n long")
    assert plain(trie.prefix_trie(trie.rebuilt_conversations(wide), 5)) == brute(rows)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op11_burst_prefix_trie"](spark, folder)
    assert plain(found) == brute(rows)
