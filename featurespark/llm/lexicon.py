"""A word lexicon as a minimal acyclic transducer: frequent words in, their token ids out."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurespark.llm.common import column_slices, once_per_worker, starts, take_runs, work_table
from featurespark.llm.merges import Merger
from featurespark.llm.words import TextEncoder

#: Words in the lexicon; what is not in it is merged exactly, so that this bounds memory and not what is encoded.
LEXICON_WORDS = 60_000

#: A word is frequent when all texts together have it so often; steps of counts are eighths of a doubling.
LEAST_COUNT = 16

#: Words whose ids a worker remembers.
MEMO_WORDS = 300_000

#: Bytes of the longest word that the lexicon takes.
LONGEST = 32


class Transducer:
    """A minimal automaton over bytes whose arcs carry numbers; the sum along a word is the word's number.

    States with the same arcs are one state. An arc's number is how many words leave its state by smaller labels,
    and one for a word that ends there, so that the words are numbered in sorted order. `ids` of word n are
    flat[first[n] : first[n + 1]].
    """

    PARTS = ("keys", "target", "add", "final", "first", "flat")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.keys, self.target, self.add, self.final, self.first, self.flat = (arrays[p] for p in self.PARTS)

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """From words in ascending order without repeats."""
        register: dict[tuple, int] = {}
        words_below: list[int] = []
        arcs_of: list[tuple] = []

        def freeze(node: list) -> int:
            signature = (node[0], *node[1])
            if signature not in register:
                register[signature] = len(arcs_of)
                arcs_of.append((node[0], tuple(node[1])))
                words_below.append(node[0] + sum(words_below[t] for _, t in node[1]))
            return register[signature]

        path: list[list] = [[0, []]]
        previous = b""
        for word in words:
            common = len(os.path.commonprefix((previous, word)))
            while len(path) > common + 1:
                done = freeze(path.pop())
                path[-1][1].append((previous[len(path) - 1], done))
            path.extend([0, []] for _ in range(len(word) - common))
            path[-1][0] = 1
            previous = word
        while len(path) > 1:
            done = freeze(path.pop())
            path[-1][1].append((previous[len(path) - 1], done))
        root = freeze(path[0])
        order = [root, *(s for s in range(len(arcs_of)) if s != root)]
        place = {s: i for i, s in enumerate(order)}
        keys, target, add = [], [], []
        for state in order:
            passed = arcs_of[state][0]
            for label, to in arcs_of[state][1]:
                keys.append(place[state] * 256 + label)
                target.append(place[to])
                add.append(passed)
                passed += words_below[to]
        length = np.array([len(x) for x in ids], np.int64)
        return cls(
            {
                "keys": np.array(keys, np.int64),
                "target": np.array(target, np.int64),
                "add": np.array(add, np.int64),
                "final": np.array([arcs_of[s][0] for s in order], np.int64),
                "first": np.append(starts(length), length.sum()).astype(np.int64),
                "flat": np.array([i for x in ids for i in x], np.int64),
            }
        )

    def pack(self) -> np.ndarray:
        """All of it as 64-bit integers: the six sizes, then the six arrays."""
        arrays = [getattr(self, p) for p in self.PARTS]
        return np.concatenate([np.array([len(a) for a in arrays], np.int64), *arrays])

    @classmethod
    def map(cls, packed: np.ndarray) -> Transducer:
        """From a memory-mapped file of the worker; the name goes at once, the mapping stays."""
        with tempfile.TemporaryDirectory() as folder:
            np.save(f"{folder}/lexicon.npy", packed)
            mapped = np.load(f"{folder}/lexicon.npy", mmap_mode="r")
        sizes = mapped[:6].tolist()
        begin = 6 + starts(np.array(sizes))
        return cls({p: mapped[b : b + n] for p, b, n in zip(cls.PARTS, begin.tolist(), sizes, strict=True)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that are not here; all words take a step at a time."""
        number = np.full(len(words), -1, np.int64)
        size = np.array([len(w) for w in words], np.int64)
        rows = np.flatnonzero((size <= LONGEST) & (size > 0))
        if not len(rows) or not len(self.keys):
            return number
        width = int(size[rows].max())
        table = np.zeros((len(rows), width), np.uint8)
        table[np.arange(width) < size[rows][:, None]] = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        state, total, size = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), size[rows]
        for step in range(width):
            key = state * 256 + table[:, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            state, total = self.target[at[on]], total[on] + self.add[at[on]]
            rows, table, size = rows[on], table[on], size[on]
            ended = size == step + 1
            found = ended & (self.final[state] == 1)
            number[rows[found]] = total[found]
            state, total, rows, table, size = (x[~ended] for x in (state, total, rows, table, size))
        return number


class LexiconWords:
    """Ids of words: those of the mapped lexicon by one walk, the others by exact merges."""

    def __init__(self, lexicon: Transducer, merger: Merger) -> None:
        self._lexicon, self._merger = lexicon, merger

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        number = self._lexicon.find(raw)
        unseen = np.flatnonzero(number < 0)
        merged, merged_count = self._merger.encode([raw[i] for i in unseen.tolist()])
        begin, length = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        seen = number >= 0
        begin[seen] = self._lexicon.first[number[seen]]
        length[seen] = self._lexicon.first[number[seen] + 1] - begin[seen]
        begin[unseen] = starts(merged_count) + len(self._lexicon.flat)
        length[unseen] = merged_count
        return take_runs(np.concatenate((self._lexicon.flat, merged)), begin, length), length


def _lexicon_encoder(tokenizer: str, name: str, packed: Broadcast) -> TextEncoder:
    lexicon = Transducer.map(packed.value)
    return TextEncoder(tokenizer, LexiconWords(lexicon, once_per_worker("lexicon", Merger, tokenizer)), MEMO_WORDS)


def count_words(documents: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """How often each word of the tokenizer occurs in all texts; tasks send their own totals."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = once_per_worker("lexicon", TextEncoder, tokenizer).splitter
        for _, texts in column_slices(batches, 0):
            words = splitter.split(texts)
            count = np.bincount(words.number[words.number >= 0], minlength=len(words.begin))
            kept = np.flatnonzero((words.size <= LONGEST) & (count > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.strings(kept), pa.string()), pa.array(count[kept], pa.int64())], ["word", "n"]
            )

    counts = documents.select(text_column).mapInArrow(task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(
    documents: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, text_column: str = "text"
) -> Transducer:
    """Compile the frequent words of all texts: those above the lowest step of counts that leaves at most `most`."""
    counts = count_words(documents, tokenizer, text_column).filter(F.col("n") >= LEAST_COUNT)
    counts = work_table(counts.withColumn("step", F.floor(8 * F.log2("n"))), "frequent")
    held, least = 0, None
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        if held + row["count"] > most:
            break
        held, least = held + row["count"], row["step"]
    words = sorted(r.word.encode() for r in counts.filter(F.col("step") >= least).select("word").collect()) if held else []
    words = [w for w in words if 0 < len(w) <= LONGEST]
    flat, count = Merger(tokenizer).encode(words)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if words else []
    return Transducer.build(words, ids)


def encode(
    documents: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    most: int = LEXICON_WORDS,
    decoded: bool = False,
    listed: bool = False,
) -> DataFrame:
    """Token ids of every whole text, as little-endian 32-bit integers, by lexicon and exact merges.

    `decoded` adds the text that the ids stand for, in `text`; `listed` adds them as decimal numbers with commas
    between. The lexicon is compiled from the word counts of all texts; workers map its file into memory. Null texts
    are empty and give no ids; null and repeated ids are kept as they are; an empty table gives an empty lexicon and
    no rows; other columns are not read. Executors get the lexicon, whose size `most` bounds, by broadcast.
    """
    lexicon = build_lexicon(documents, tokenizer, most, text_column)
    packed, name = documents.sparkSession.sparkContext.broadcast(lexicon.pack()), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker("lexicon", _lexicon_encoder, tokenizer, name, using=(packed,))
        for batch, texts in column_slices(batches):
            flat, count = encoder.encode(texts)
            ids = _cut(flat.astype("<u4").tobytes(), 4 * count)
            columns, names = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], ["n_tokens", "ids"]
            if decoded:
                columns.append(decode_ids(flat, count, tokenizer))
                names.append("text")
            if listed:
                columns.append(list_ids(flat, count, tokenizer))
                names.append("listed")
            yield pa.RecordBatch.from_arrays(columns, [id_column, *names])

    kind = documents.schema[id_column].dataType.simpleString()
    more = ", text string" * decoded + ", listed string" * listed
    rows = documents.select(id_column, text_column)
    return rows.mapInArrow(task, f"`{id_column}` {kind}, n_tokens long, ids binary{more}")


def _cut(raw: bytes, size: np.ndarray) -> list[bytes]:
    first = starts(size)
    return [raw[b : b + n] for b, n in zip(first.tolist(), size.tolist(), strict=True)]


def byte_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings one after the other, and where each begins and how long it is."""
    size = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), starts(size), size


def _token_bytes(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = once_per_worker("lexicon", Merger, tokenizer).bytes_of
    return byte_table([known.get(i, b"") for i in range(max(known) + 1)])


def _token_digits(tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return byte_table([b"%d," % i for i in range(max(once_per_worker("lexicon", Merger, tokenizer).bytes_of) + 1)])


def replaced(flat: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, ...]) -> list[bytes]:
    """What the ids of each text are replaced by."""
    pieces, begin, size = table
    length = size[flat]
    total = np.append(0, np.cumsum(length))
    ends = np.append(0, np.cumsum(count))
    return _cut(take_runs(pieces, begin[flat], length).tobytes(), np.diff(total[ends]))


def decode_ids(flat: np.ndarray, count: np.ndarray, tokenizer: str) -> pa.Array:
    """Decoded texts; bytes that are not UTF-8 become replacement signs."""
    raw = replaced(flat, count, once_per_worker("lexicon", _token_bytes, tokenizer))
    return pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())


def list_ids(flat: np.ndarray, count: np.ndarray, tokenizer: str) -> pa.Array:
    """The ids of each text as decimal numbers with commas between."""
    raw = replaced(flat, count, once_per_worker("lexicon", _token_digits, tokenizer))
    return pa.array([r[:-1].decode("ascii") for r in raw], pa.string())
