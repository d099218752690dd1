"""Exact duplicates by two-pass Bloom filtering: only rows whose text may occur again are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import Scratch, join_groups, numbered, without_rows

WHITE_SPACE = r"[\x20\x09-\x0D]+"

#: Bits of one filter segment, filter bits for each document, and bits set for each text.
SEGMENT_BITS, BITS_PER_DOCUMENT, PROBES = 1 << 20, 16, 3

#: Filter bytes that are broadcast at once; a larger filter takes several rounds.
ROUND_BYTES = 64 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash and its places in it, one row per probe."""
    first = _mixed(hashes)
    segment = (first >> np.uint64(20)) % np.uint64(segments)
    second = _mixed(first)
    step = np.array([0, 20, 40], np.uint64)[:PROBES, None]
    return segment.astype(np.int64), ((second >> step) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _digests(documents: DataFrame, id_column: str, text_column: str, row: Column) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), WHITE_SPACE, " ")
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = documents.select(F.col(id_column).alias("doc_id"), row.alias("row"), sha.alias("sha"))
    return rows.withColumn("hash", F.xxhash64("sha"))


def repeated_filter(digests: DataFrame, segments: int) -> DataFrame:
    """First pass: one row per segment that has a place set by two rows, with those places as bits.

    Each task sends, per segment, the places its hashes set and those that two equal hashes of its own set; where
    tasks meet, a place already set is marked as repeated. A place is sent once by a task, however often a hash
    occurs there.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.column(0).to_numpy().astype(np.uint64) for batch in batches]
        if not parts:
            return
        hashes, count = np.unique(np.concatenate(parts), return_counts=True)
        segment, places = _places(hashes, segments)
        order = np.argsort(segment, kind="stable")
        edges = np.flatnonzero(np.diff(segment[order])) + 1
        for rows in np.split(order, edges):
            set_ = np.unique(places[:, rows]).astype("<u4")
            again = np.unique(places[:, rows[count[rows] > 1]]).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(segment[rows[0]])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (set_, again))],
                ["segment", "places", "repeated"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, again = None, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and again.any():
                bits = pa.array([np.packbits(again).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), bits], ["segment", "bits"])

        for batch in batches:
            for segment, places, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    yield from done()
                    now = segment
                    seen[:], again[:] = False, False
                set_ = np.frombuffer(places, "<u4")
                again[set_[seen[set_]]] = True
                again[np.frombuffer(repeated, "<u4")] = True
                seen[set_] = True
        yield from done()

    sent = digests.select("hash").mapInArrow(own, "segment long, places binary, repeated binary")
    dealt = sent.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(merged, "segment long, bits binary")


def _probe(digests: DataFrame, filters: DataFrame, segments: int, work: Scratch) -> DataFrame:
    """Second pass: mark the rows whose places are all repeated, as many segments at a time as may be broadcast.

    When the filter takes several rounds the digests are written once more, each row to the folder of its round, without
    a shuffle; a round reads its own folder, so that every digest is read a fixed number of times at any size.
    """
    spark, kind = digests.sparkSession, digests.schema["doc_id"].dataType.simpleString()
    context = spark.sparkContext
    each = max(1, ROUND_BYTES // (SEGMENT_BITS // 8))
    rounds, schema = range(0, segments, each), f"doc_id {kind}, row long, sha binary, maybe boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = _places(batch.column(3).to_numpy().astype(np.uint64), segments)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment // each)], [*batch.schema.names, "round"])

    def probed(rows: DataFrame, low: int) -> DataFrame:
        found = filters.filter((F.col("segment") >= low) & (F.col("segment") < low + each)).collect()
        held = context.broadcast({r.segment: bytes(r.bits) for r in found})

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = sorted(held.value)
            table = np.frombuffer(b"".join(held.value[n] for n in names), np.uint8).reshape(len(names), SEGMENT_BITS // 8)
            row_of = np.full(each, -1, np.int64)
            row_of[np.array(names, np.int64) - low] = np.arange(len(names))
            for batch in batches:
                segment, places = _places(batch.column(3).to_numpy().astype(np.uint64), segments)
                row = row_of[segment - low]
                maybe = row >= 0
                if len(names):
                    for place in places:
                        maybe &= (table[row, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maybe)], ["doc_id", "row", "sha", "maybe"])

        return rows.mapInArrow(task, schema)

    if len(rounds) == 1:
        return work.table(probed(digests, 0), "probed")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.schema.fields)
    dealt = work.table(digests.mapInArrow(deal, f"{fields}, round long"), "dealt", "round")
    return work.table_of(
        (probed(dealt.filter(F.col("round") == r).select(*digests.columns), low) for r, low in enumerate(rounds)), schema, "probed"
    )


def exact_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", row: Column | None = None
) -> DataFrame:
    """One row per document: which row of its group of equal texts stays.

    Texts are equal when they are after each run of white space has become one space; null is empty. Of equal texts
    the smallest id stays, null ids last, and of rows with equal ids the one read first. Columns: doc_id, `row` (the
    row's number in reading order), keep_id, group_size, kept, text_sha256. Rows that the filter clears are in groups
    of one and are not shuffled; the others are counted before they meet, and groups with many rows are joined
    without a shuffle. The filter has a fixed number of bits per document. Other columns are not read; an empty table
    gives no rows.
    """
    row, work = F.monotonically_increasing_id() if row is None else row, Scratch(documents.sparkSession)
    digests = work.table(_digests(documents, id_column, text_column, row), "digests")
    total = digests.count()
    segments = max(1, -(-total * BITS_PER_DOCUMENT // SEGMENT_BITS))
    filters = work.table(repeated_filter(digests, segments), "filter")
    probed = _probe(digests, filters, segments, work)
    alone = probed.filter("not maybe").select(
        "doc_id", "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    again = probed.filter("maybe").select("doc_id", "row", "sha")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    groups = again.groupBy("sha").agg(first, F.count("*").alias("group_size"))
    joined = join_groups(again, groups, "sha", "group_size", total).select(
        "doc_id", "row", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "sha",
    )
    return work.result(alone.unionByName(joined).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha"), "groups")


def drop_exact_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows are numbered once, in a table that is written down, and dropped by their number.
    """
    held, row = numbered(documents)
    groups = exact_groups(held, id_column, text_column, F.col(row))
    return without_rows(held, row, groups.filter("not kept").select("row"))
