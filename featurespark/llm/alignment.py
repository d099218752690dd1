"""Alignment of two tokenizations of the same texts: shared ends, windows between anchors, and corpus-wide links."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import Scratch, column_slices, once_per_worker, starts, take_runs
from featurespark.llm.lexicon import byte_table, replaced
from featurespark.llm.merges import byte_signs
from featurespark.llm.words import Splitter, TextEncoder, WordIds, Words

#: Windows that a worker remembers.
MEMO_WINDOWS = 400_000

#: A pair of ids is common when it holds more than one in so many links; hence there are at most so many common pairs.
COMMON_PART = 1 << 18

DOCUMENT_SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary"
)


class Vocabulary:
    """For each id of a tokenizer how many bytes its token has, and whether it begins with a space."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.table = tokens, byte_table(tokens)
        self.size = self.table[2]
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    of_byte = {sign: bytes([b]) for b, sign in enumerate(byte_signs())}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        tokens[number] = b"".join(of_byte.get(sign, sign.encode()) for sign in token)
    return tokens


def piece_tokens(pieces: list[str]) -> list[bytes]:
    """Pieces in UTF-8 with their mark of a space as a space; <0xHH> is a byte."""
    one = re.compile(r"<0x([0-9A-F]{2})>")
    return [
        bytes([int(found[1], 16)]) if (found := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces
    ]


#: Marks in the first number of a link: its token of A, or of B, ends with it.
ENDS_A, ENDS_B = np.uint32(1 << 31), np.uint32(1 << 30)

#: What stands between the ids of A and those of B in the codes of a window.
BETWEEN = np.uint32(0xFFFFFFF0)


class Windows(Words):
    """The windows of some texts as words whose codes are the ids of A, BETWEEN, and the ids of B.

    Windows lie between anchors: ends that both tokenizations share and after which both go on with a token that begins
    with a space. `a`, `b` are all ids; `cut_a`, `cut_b` say where in them each window ends.
    """

    def __init__(self, splitter: Splitter, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> None:
        self.a, self.b = a, b
        self.begin_a, self.begin_b = (np.concatenate(([0], cut[:-1])) for cut in (cut_a, cut_b))
        self.size_a, self.size_b = cut_a - self.begin_a, cut_b - self.begin_b
        at = np.arange(len(cut_a))
        codes = np.full(len(a) + len(b) + len(at), BETWEEN, np.uint32)
        codes[np.arange(len(a)) + np.repeat(self.begin_b + at, self.size_a)] = a
        codes[np.arange(len(b)) + np.repeat(cut_a + at + 1, self.size_b)] = b
        first = self.begin_a + self.begin_b + at
        digest, number, self.lead = splitter.distinct(codes, first)
        size = self.size_a[self.lead] + self.size_b[self.lead] + 1
        super().__init__("", codes, first[self.lead], size, digest, number, at)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of A and of B of some distinct windows, and how many each has."""
        lead = self.lead[which]
        size_a, size_b = self.size_a[lead], self.size_b[lead]
        return take_runs(self.a, self.begin_a[lead], size_a), size_a, take_runs(self.b, self.begin_b[lead], size_b), size_b


class Aligner:
    """Aligns the tokens of whole texts window by window; windows met before are looked up by their ids."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._a = TextEncoder(byte_level, plain=True)
        self._b = SentencePieceProcessor(model_file=pieces)
        self.a = Vocabulary(byte_level_tokens(self._a.tokenizer.get_vocab(with_added_tokens=True)))
        self.b = Vocabulary(piece_tokens([self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]))
        self.known = WordIds(self._align, MEMO_WINDOWS)
        self._ids = max(len(self.a.tokens), len(self.b.tokens))
        self._digits = byte_table([b"%d%c" % (i, sign) for sign in b",|;" for i in range(self._ids)])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of all texts by A, how many each has, and the same by B; none where they don't spell the text's bytes."""
        a, count_a = self._a.encode([f" {t}" for t in texts])
        found = self._b.encode(texts, num_threads=1)
        count_b = np.array([len(x) for x in found], np.int64)
        b = np.fromiter(chain.from_iterable(found), np.uint32, int(count_b.sum()))
        spelt = zip(replaced(a, count_a, self.a.table), replaced(b, count_b, self.b.table), texts, strict=True)
        same = np.array([bool(t) and x == y == b" " + t.encode() for x, y, t in spelt], bool)
        return a[np.repeat(same, count_a)], count_a * same, b[np.repeat(same, count_b)], count_b * same

    def windows(self, a: np.ndarray, count_a: np.ndarray, b: np.ndarray) -> Windows:
        """Texts one after the other spell the same bytes by both, so their ends are shared as well."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at_b = np.searchsorted(end_b, end_a)
        spaced_a, spaced_b = (np.append(v.spaced[ids[1:]], True) for v, ids in ((self.a, a), (self.b, b)))
        whole = np.zeros(len(a), bool)
        whole[np.cumsum(count_a)[count_a > 0] - 1] = True
        anchor = (end_b[at_b] == end_a) & (whole | (spaced_a & spaced_b[at_b]))
        return Windows(self._a.splitter, a, b, np.flatnonzero(anchor) + 1, at_b[anchor] + 1)

    def _align(self, new: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Links of windows: two numbers each, the id of A with its marks and the id of B.

        Between two neighbouring ends of either tokenization lies exactly one link.
        """
        a, size_a, b, size_b = new
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = np.empty((len(ends), 2), np.uint32)
        links[:, 0] = a[at_a] | np.where(end_a[at_a] == ends, ENDS_A, 0) | np.where(end_b[at_b] == ends, ENDS_B, 0)
        links[:, 1] = b[at_b]
        window = np.searchsorted(end_a[np.cumsum(size_a) - 1], ends)
        return links.ravel(), 2 * np.bincount(window, minlength=len(size_a))

    def _listed(self, links: np.ndarray, link_count: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """The groups of each text: ids of A and of B in the order of groups, with the signs that follow them."""
        closed = ends_a & ends_b
        group = np.cumsum(closed) - closed
        group_a, group_b = group[ends_a], group[ends_b]
        groups = int(closed.sum())
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(group_a)) + starts(of_b)[group_a]
        place_b = np.arange(len(group_b)) + np.cumsum(of_a)[group_b]
        stream = np.empty(len(place_a) + len(place_b), np.int64)
        stream[place_a] = links[ends_a, 0] & ~(ENDS_A | ENDS_B)
        stream[place_b] = links[ends_b, 1]
        stream[place_a[np.cumsum(of_a) - 1]] += self._ids
        stream[place_b[np.cumsum(of_b) - 1]] += 2 * self._ids
        text = np.repeat(np.arange(len(link_count)), link_count)
        tokens = np.bincount(text, ends_a.astype(np.int64) + ends_b, len(link_count)).astype(np.int64)
        return replaced(stream, tokens, self._digits)

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and their times of each text."""
        a, count_a, b, count_b = self.tokens(texts)
        if not len(a):
            yield from ((0, 0, 0, 0, "", b"", b"") for _ in texts)
            return
        windows = self.windows(a, count_a, b)
        flat, begin, length = self.known.of(windows)
        size = length[windows.number]
        links = take_runs(flat, begin[windows.number], size).reshape(-1, 2)
        text = np.searchsorted(np.cumsum(count_a), windows.begin_a, "right")
        link_count = np.bincount(text, size // 2, len(texts)).astype(np.int64)
        ends_a, ends_b = (links[:, 0] & mark > 0 for mark in (ENDS_A, ENDS_B))
        owner = np.repeat(np.arange(len(texts)), link_count)
        groups = np.bincount(owner, ends_a & ends_b, len(texts)).astype(np.int64)
        listed = self._listed(links, link_count, ends_a, ends_b)
        pairs = ((links[:, 0] & ~(ENDS_A | ENDS_B)).astype(np.uint64) << np.uint64(32)) | links[:, 1]
        high = np.cumsum(link_count)
        for i, (one, two) in enumerate(zip(count_a.tolist(), count_b.tolist(), strict=True)):
            distinct, times = np.unique(pairs[high[i] - link_count[i] : high[i]], return_counts=True)
            digest = hashlib.sha256(listed[i][:-1]).hexdigest() if one else ""
            yield one, two, int(groups[i]), int(link_count[i]), digest, distinct.tobytes(), times.astype("<u4").tobytes()


def aligned_documents(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """DOCUMENT_SCHEMA: counts and digest of the groups of each document, its distinct linked pairs and their times."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once_per_worker("alignment", Aligner, byte_level, pieces)
        names = [x.split()[0] for x in DOCUMENT_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch, texts in column_slices(batches, 2):
            columns = zip(*aligner.rows(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(task, DOCUMENT_SCHEMA)


def _link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): links of each pair of ids; each task adds up what it can before it sends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

        def batch_of(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(times)], ["pair", "n"])

        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            times = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4")
            held.append((pairs, times.astype(np.int64)))
            if sum(len(p) for p, _ in held) > 4_000_000:
                held = [summed()]
                if len(held[0][0]) > 2_000_000:
                    yield batch_of(*held[0])
                    held = []
        if held:
            yield batch_of(*summed())

    sent = aligned.select("pairs", "times").mapInArrow(task, "pair long, n long")
    return sent.groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document how its tokens by two tokenizers fall together, and what its links weigh in the whole corpus.

    `byte_level` names a byte-level tokenizer file that reads a space and the text (A), `pieces` a sentencepiece model
    that reads the text (B). Byte offsets where tokens of both end cut the text into groups; a link is a pair of
    tokens whose bytes overlap; a pair of ids counts all its links in the corpus. Columns: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose count is the highest of their B id), count_sum (counts summed over links) and
    groups_sha256. Null and empty texts, and texts whose bytes one of the tokenizers does not keep, have no tokens.
    Ids may be null or repeated, other columns are not read, an empty table gives no rows.

    Texts are read once; ids of pairs and their times in each document are kept in a work table. The commonest pairs,
    at most COMMON_PART, are broadcast with their counts; other pairs are joined by a shuffle, where none is hot.
    """
    spark = documents.sparkSession
    work = Scratch(spark)
    aligned = work.table(aligned_documents(documents, byte_level, pieces), "aligned")
    counts = work.table(_link_counts(aligned), "counts")
    # One row per id of B, a number that the vocabulary bounds.
    best = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.join(F.broadcast(best), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b"))
    weighed = work.table(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "weighed")
    total = weighed.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total // COMMON_PART
    frequent = sorted(tuple(r) for r in weighed.filter(often).collect())
    table = np.array(frequent, np.int64).reshape(-1, 3)
    held = spark.sparkContext.broadcast((table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()))

    def lookup(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = held.value[0]
        if not len(names):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(names, pairs), len(names) - 1)
        return at, names[at] == pairs

    def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = batch.column("pairs").to_pylist()
        owner = np.repeat(np.arange(batch.num_rows), [len(p) // 8 for p in raw])
        return owner, np.frombuffer(b"".join(raw), np.int64), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pairs, times = links(batch)
            other = ~lookup(pairs)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[other]) for x in (batch.column("row").to_numpy()[owner], pairs, times.astype(np.int64))],
                ["row", "pair", "times"],
            )

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pairs, times = links(batch)
            at, known = lookup(pairs)
            owner, at, times = owner[known], at[known], times[known].astype(np.int64)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, times * held.value[2][at] if len(at) else times)
            np.add.at(sums[1], owner, times * held.value[1][at] if len(at) else times)
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, sums)],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own_best", "own_sum"],
            )

    tail = aligned.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long")
    tail = tail.join(weighed.filter(~often), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum")
    )
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own_best long, own_sum long"
    rows = aligned.mapInArrow(common, schema).join(tail, "row", "left")
    result = rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("own_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("own_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
    return work.result(result, "alignment")
