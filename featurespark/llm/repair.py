"""Token files compressed by a pair grammar, one grammar per shard, with random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices, once_per_worker, starts, take_runs
from featurespark.llm.words import TextEncoder

#: Ids of one shard: what a task holds and what one grammar describes.
SHARD_IDS = 1 << 20

#: A pair becomes a rule when it occurs so often in what is left of the shard.
LEAST_COUNT = 2

SHARD_SCHEMA = (
    "part int, shard int, first_token long, n_ids long, doc_ids binary, doc_null binary, doc_tokens binary, "
    "terminals int, rules binary, lengths binary, body binary, body_docs binary"
)


class Grammar:
    """Rules (left, right) for symbols from `terminals` on, and the length of what each symbol stands for."""

    def __init__(self, rules: np.ndarray, terminals: int, lengths: np.ndarray | None = None) -> None:
        self.rules, self.terminals, self.opened = rules, terminals, 0
        self.lengths = np.ones(terminals + len(rules), np.int64) if lengths is None else lengths
        if lengths is None:
            for begin, end in self._layers():
                pair = self.lengths[rules[begin:end]]
                self.lengths[terminals + begin : terminals + end] = pair.sum(1)

    def _layers(self) -> Iterator[tuple[int, int]]:
        """Ranges of rules that use only symbols made before the range."""
        most = self.rules.max(1).astype(np.int64) - self.terminals if len(self.rules) else np.zeros(0, np.int64)
        begin = 0
        while begin < len(self.rules):
            late = np.flatnonzero(most[begin:] >= begin)
            end = begin + int(late[0]) if len(late) else len(self.rules)
            yield begin, end
            begin = end

    def expand(self, body: np.ndarray) -> np.ndarray:
        """The ids that a sequence of symbols stands for, layer by layer."""
        size = self.lengths[self.terminals :]
        flat = np.zeros(int(size.sum()) + self.terminals, np.uint32)
        flat[: self.terminals] = np.arange(self.terminals)
        first = np.concatenate((np.arange(self.terminals), self.terminals + starts(size))) if len(size) else np.arange(self.terminals)
        for begin, end in self._layers():
            symbols = self.rules[begin:end].ravel()
            made = take_runs(flat, first[symbols], self.lengths[symbols])
            at = int(first[self.terminals + begin])
            flat[at : at + len(made)] = made
        return take_runs(flat, first[body], self.lengths[body])

    def part(self, body: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of what `body` stands for.

        From the top down: rules whose ids all lie outside are dropped by their lengths, others replaced by their two
        sides, so that about the depth of the grammar times the ids asked for is looked at; `self.opened` counts it.
        """
        symbols = body.astype(np.int64)
        first = starts(self.lengths[symbols])
        while True:
            near = (first < end) & (first + self.lengths[symbols] > begin)
            symbols, first = symbols[near], first[near]
            rule = symbols >= self.terminals
            if not rule.any():
                return symbols.astype(np.uint32)
            self.opened += int(rule.sum())
            place = np.cumsum(rule + 1) - 1
            spread, spread_first = np.empty(int(place[-1]) + 1, np.int64), np.empty(int(place[-1]) + 1, np.int64)
            left, right = self.rules[symbols[rule] - self.terminals].astype(np.int64).T
            spread[place[~rule]], spread_first[place[~rule]] = symbols[~rule], first[~rule]
            spread[place[rule] - 1], spread_first[place[rule] - 1] = left, first[rule]
            spread[place[rule]], spread_first[place[rule]] = right, first[rule] + self.lengths[left]
            symbols, first = spread, spread_first


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace repeated pairs by new symbols, round after round, until no pair occurs `least` times.

    `last` marks the last id of each document; no pair crosses it. In a round all pairs that occur `least` times are
    ranked by their count, and a place is replaced when its pair ranks before those of both neighbours. In a run of
    one symbol every second place is replaced at once. A rule is kept when it is used twice at least. A pair seen once
    is never looked at again: only places next to a replaced one can hold a new pair. Returns the rules, the remaining
    symbols and their marks.
    """
    body, last, rules, made = ids.astype(np.uint32), last.copy(), [], 0
    live = np.ones(len(body), bool)  # places whose pair may occur again
    while len(body) > 1:
        live[-1] = False
        live &= ~last
        spots, edges = _by_pair(body, np.flatnonzero(live), terminals + made)
        often = np.diff(edges, append=len(spots))
        frequent = np.flatnonzero(often >= least)
        if not len(frequent):
            break
        begin, often = edges[frequent], often[frequent]
        by_count = _largest_first(often)
        rank = np.empty(len(by_count), np.int32)
        rank[by_count] = np.arange(len(by_count), dtype=np.int32)
        first = spots.take(begin)
        spots = take_runs(spots, begin, often)
        live = np.zeros(len(body), bool)
        live[spots] = True
        none = np.int32(len(first))
        place = np.full(len(body) + 1, none, np.int32)
        place[spots] = np.repeat(rank, often)
        chosen = _chosen(place, np.flatnonzero(live))
        pair = place.take(chosen)
        kept = np.bincount(pair, minlength=len(first)) >= 2
        if not kept.any():
            break
        used = np.flatnonzero(kept.take(pair))
        chosen, pair = chosen.take(used), pair.take(used)
        name = (np.cumsum(kept) - 1 + terminals + made).astype(np.uint32)
        by_rank = first.take(by_count.take(np.flatnonzero(kept)))
        rules.append(np.stack((body.take(by_rank), body.take(by_rank + 1)), 1))
        made += len(by_rank)
        body[chosen] = name.take(pair)
        last[chosen] |= last.take(chosen + 1)
        live[chosen] = True
        live[np.maximum(chosen - 1, 0)] = True
        stays = np.ones(len(body), bool)
        stays[chosen + 1] = False
        # A place before a replaced pair now stands before its new symbol.
        moved = chosen[np.searchsorted(chosen, 2) :] - 1
        live[moved.take(np.flatnonzero(~stays.take(moved))) - 1] = True
        # Numpy copies long runs of a mask at once, but is slow where a mask often turns.
        left = stays if 16 * len(chosen) < len(body) else np.flatnonzero(stays)
        body, last, live = body[left], last[left], live[left]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return table, body, last


def _by_pair(body: np.ndarray, spots: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their pairs, and where in it each pair begins.

    Pair and place are sorted as one number where 64 bits hold both.
    """
    bits, place_bits = int(symbols).bit_length(), len(body).bit_length()
    packed = 2 * bits + place_bits <= 64
    key = body.take(spots).astype(np.uint64)
    key <<= np.uint64(bits if packed else 32)
    key |= body.take(spots + 1)
    if packed:
        key <<= np.uint64(place_bits)
        key |= spots.view(np.uint64)
        key.sort()
        spots = (key & np.uint64((1 << place_bits) - 1)).view(np.int64)
        key >>= np.uint64(place_bits)
    else:
        order = np.argsort(key, kind="stable")
        spots, key = spots[order], key[order]
    begins = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=begins[1:])
    return spots, np.flatnonzero(begins)


def _largest_first(count: np.ndarray) -> np.ndarray:
    """The places of the counts, the largest first and equal ones in their order; counts and places are below 2**31."""
    key = (np.int64(1 << 31) - count) << np.int64(32)
    key |= np.arange(len(count))
    key.sort()
    return key & np.int64(0xFFFFFFFF)


def _chosen(place: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The places that rank before their neighbours, every second one of a run of equal places.

    `spots` are the places with a rank; the last of `place` has none, so it stands before the first as well.
    """
    own, before, after = place.take(spots), place.take(spots - 1, mode="wrap"), place.take(spots + 1)
    best = (own < before) & (own < after)
    alike = np.flatnonzero((own == before) | (own == after))
    if len(alike):
        spot, own, before, after = spots[alike], own[alike], before[alike], after[alike]
        begins = before != own
        run = np.cumsum(begins) - 1
        # A run that follows a better place begins one later.
        begin = np.flatnonzero(begins)
        start = spot.take(begin) + (before.take(begin) < own.take(begin))
        offset = spot - start.take(run)
        best[alike] = (offset >= 0) & (offset % 2 == 0) & (after >= own)
    return spots.take(np.flatnonzero(best))


def write_tokens(
    documents: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = 0,
    parts: int | None = None,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Write the ids of all documents, in ascending doc_id order, as grammar shards below `path`.

    Each document is its ids and then `end_id`. Rows are dealt out by ranges of doc_id (then text and place, so
    that repeated ids spread as well) and sorted inside them; each range is cut into shards of about `shard_ids` ids,
    a document staying whole. A shard is one row of a Parquet table: range and number (`part`, `shard`), ids before
    it in its range, ids, null marks and token counts of its documents, and the grammar: `rules` as pairs of symbols,
    `lengths` of what the rules stand for, the `body`, and its symbols per document. Null texts are empty; null ids
    come first; repeated ids are documents of their own; other columns are not read; an empty table gives an empty file
    set.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker("repair", TextEncoder, tokenizer)
        terminals = encoder.tokenizer.get_vocab_size()
        part, shard, first = TaskContext.get().partitionId(), 0, 0

        def done(keys: list, ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            flat, count = np.concatenate(ids), np.concatenate(counts)
            last = np.zeros(len(flat), bool)
            last[np.cumsum(count) - 1] = True
            rules, body, ends = compress(flat, last, terminals)
            grammar = Grammar(rules, terminals)
            null = np.array([k is None for k in keys], np.uint8)
            columns = [
                np.array([k or 0 for k in keys], "<i8"), null, count.astype("<u4"), rules.astype("<u4"),
                grammar.lengths[terminals:].astype("<u4"), body.astype("<u4"),
                np.diff(np.flatnonzero(ends), prepend=-1).astype("<u4"),
            ]
            key, mark, tokens, *rest = (pa.array([c.tobytes()], pa.binary()) for c in columns)
            numbers = ((part, pa.int32()), (shard, pa.int32()), (first, pa.int64()), (len(flat), pa.int64()))
            head = [pa.array([x], kind) for x, kind in numbers]
            names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays(
                [*head, key, mark, tokens, pa.array([terminals], pa.int32()), *rest], names
            )

        keys, ids, counts, held = [], [], [], 0
        for batch, texts in column_slices(batches):
            flat, count = encoder.encode(texts, end_id)
            keys += batch.column(0).to_pylist()
            ids.append(flat)
            counts.append(count)
            held += len(flat)
            if held >= shard_ids:
                yield done(keys, ids, counts)
                shard, first = shard + 1, first + held
                keys, ids, counts, held = [], [], [], 0
        if keys:
            yield done(keys, ids, counts)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", keys[1].alias("digest"), keys[2].alias("place"))
    order = ["doc_id", "digest", "place"]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_.mapInArrow(task, SHARD_SCHEMA).write.parquet(path)


def _grammar(row: dict) -> Grammar:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    sizes = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    return Grammar(rules, row["terminals"], np.concatenate((np.ones(row["terminals"], np.int64), sizes)))


def read_document(row: dict, number: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin..end of one document of a shard row, expanding only what covers them."""
    symbols = np.frombuffer(row["body_docs"], "<u4").astype(np.int64)
    at = int(symbols[:number].sum())
    body = np.frombuffer(row["body"], "<u4")[at : at + symbols[number]]
    count = int(np.frombuffer(row["doc_tokens"], "<u4")[number])
    return _grammar(row).part(body, begin, count if end is None else end)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read grammar shards back: doc_id, ids of all documents before it (`start`), `n_tokens`, the `ids` as bytes.

    What precedes a document is the sum over earlier ranges, one number per range and so a small table, plus what
    its shard and its document have before them. Null and repeated ids come back as they were written; an empty file set
    gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = np.frombuffer(row["body"], "<u4")
                flat = _grammar(row).expand(body).astype("<u4")
                count = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                null = np.frombuffer(row["doc_null"], np.uint8).astype(bool)
                key = np.frombuffer(row["doc_ids"], "<i8")
                first = starts(count)
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64(), mask=null),
                        pa.array(first + row["first_token"] + row["base"], pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array([raw[4 * b : 4 * (b + n)] for b, n in zip(first.tolist(), count.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = shards.join(F.broadcast(totals.select("part", before.alias("base"))), "part")
    return based.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")
