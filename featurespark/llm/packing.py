"""Sum-of-squares online packing of tokenized documents into windows of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark import TaskContext

from featurespark.llm.common import column_slices, map_large_blocks, once_per_worker
from featurespark.llm.words import TextEncoder

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Bits of a sequence id that number the windows of one task.
TASK_BITS = 40

#: Characters that are encoded at once.
SLICE_CHARS = 200_000


class Packer:
    """Open windows of one task, counted by fill level.

    `count[l]` is the number of open windows that hold l tokens. A piece of s tokens goes to the level l whose
    choice makes the sum of count[l]^2 over the partly filled levels smallest: moving one window from l to l + s
    adds 2 count[l + s] + 1 for the new level and 1 - 2 count[l] for the old one, and neither an empty nor a full
    window counts. Among equal levels the fullest is taken. A window is given out when it is full; `finish` fills
    the windows still open with pieces cut from the emptiest ones, so that at most one of a task stays short.
    """

    def __init__(self, window: int, first_id: int = 0) -> None:
        self.window, self._next = window, first_id
        self._count = np.zeros(window + 1, np.int64)
        self._open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A piece is (document, start, ids); what comes out has the sequence and the offset added."""
        offset = 0
        for piece in pieces:
            yield (*piece, self._next, offset)
            offset += len(piece[2])
        self._next += 1

    def level(self, size: int) -> int:
        window, count = self.window, self._count
        change = np.empty(window - size + 1, np.int64)
        np.multiply(count[size : window + 1], 2, out=change)
        change += 1
        change[window - size] = 0
        if window > size:
            change[1:] += 1 - 2 * count[1 : window - size + 1]
            change[1:][count[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        return window - size - int(change[::-1].argmin())

    def add(self, document: object, ids: np.ndarray) -> Iterator[tuple]:
        """Pack one document; longer ones than a window first fill whole windows."""
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield from self._close([(document, start, ids[start : start + self.window])])
        size = len(ids) - whole
        if not size:
            return
        level = self.level(size)
        pieces = self._open[level].pop() if level else []
        pieces.append((document, whole, ids[whole:].copy()))
        self._count[level] -= level > 0
        if level + size == self.window:
            yield from self._close(pieces)
        else:
            self._count[level + size] += 1
            self._open[level + size].append(pieces)

    def finish(self) -> Iterator[tuple]:
        """Fill the fullest windows with what the emptiest hold, cutting pieces where needed."""
        left = [(level, pieces) for level in range(self.window, 0, -1) for pieces in self._open[level]]
        first, last = 0, len(left) - 1
        spare: list[tuple] = []
        while first <= last:
            level, pieces = left[first]
            first += 1
            while level < self.window and (spare or first <= last):
                if not spare:
                    spare = left[last][1]
                    last -= 1
                document, start, ids = spare.pop()
                room = self.window - level
                pieces.append((document, start, ids[:room]))
                if len(ids) > room:
                    spare.append((document, start + room, ids[room:]))
                level += min(room, len(ids))
            yield from self._close(pieces)
        while spare:
            pieces, level = [], 0
            while spare and level < self.window:
                document, start, ids = spare.pop()
                room = self.window - level
                pieces.append((document, start, ids[:room]))
                if len(ids) > room:
                    spare.append((document, start + room, ids[room:]))
                level += min(room, len(ids))
            yield from self._close(pieces)


def pack(
    documents: DataFrame,
    tokenizer: str,
    window: int = 1024,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Cut tokenized documents into pieces and place the pieces in sequences of at most `window` tokens.

    Each document is its ids and then `end_id`. One row per piece: the document, the ids of the document before the
    piece (`start`), `length`, the `ids` as little-endian 32-bit integers, the document's tokens, the sequence and
    the place in it (`offset`). Every task packs its own rows in order and numbers its sequences from its partition
    number, so nothing is shuffled, a repeated task gives the same rows, and a task holds its open windows only.
    Null and empty texts are the end id alone; null ids are kept; repeated rows are packed like others; an empty
    table gives no rows; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large_blocks()
        encoder = once_per_worker("packing", TextEncoder, tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << TASK_BITS)

        def rows() -> Iterator[list[tuple]]:
            for batch, texts in column_slices(batches, most=SLICE_CHARS):
                flat, count = encoder.encode(texts, end_id)
                parts = np.split(flat, np.cumsum(count)[:-1])
                keys = batch.column(0).to_pylist()
                yield [
                    p for key, ids in zip(keys, parts, strict=True) for p in packer.add((key, len(ids)), ids)
                ]
            yield list(packer.finish())

        for pieces in rows():
            if pieces:
                documents_, start, ids, sequence, offset = zip(*pieces, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in documents_], id_type),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([d[1] for d in documents_], pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind = documents.schema[id_column].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    name = "string" if kind.simpleString() == "string" else "long"
    rows = documents.select(documents[id_column].cast(name), documents[text_column])
    return rows.mapInArrow(task, f"`{id_column}` {name}, {SCHEMA}")
