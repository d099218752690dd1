"""Helpers shared by the operators: work tables, bounded batches, runs of flat arrays, joins with hot keys."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.session import remove_folder, shared_folder

#: Characters that one step inside a task handles at once; it bounds memory, not what is read.
BATCH_CHARS = 400_000

#: A key is hot when it holds more than one row in so many; hence there are at most so many hot keys.
HOT_PART = 1_000

#: Rows of a file of a work table that holds ids and numbers only.
FILE_ROWS = 25_000

#: Bits of a row's number that are its place in its file.
FILE_BITS = 40

#: Objects that one operator keeps in a Python worker.
MOST_KEPT = 6

#: Parameters of the C library's mallopt, and their values in bytes: the end of the heap that stays when it is free, and
#: from which size on a block is mapped by itself.
HEAP_BOUNDS = {-1: 32 << 20, -3: 1 << 20}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the session names."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex[:12]}/{name}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_for(rows: int) -> int:
    """Files for at most so many rows of ids and numbers.

    With one for each shuffle partition most files of a small table are next to empty; each takes a task, and on local
    disks two processes that set its mode.
    """
    return max(1, -(-rows // FILE_ROWS))


class Scratch:
    """Work tables of one operator, removed from the shared folder when its result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, []

    def table(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """The table as written; `folders` names columns whose values get folders of their own."""
        path = self._path(name)
        df.write.partitionBy(*folders).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def table_of(self, parts: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
        """Parts written one after the other into one table."""
        path = self._path(name)
        for part in parts:
            part.write.mode("append").parquet(path)
        return self._spark.read.schema(schema).parquet(path)

    def _path(self, name: str) -> str:
        self._paths.append(work_path(self._spark, name))
        return self._paths[-1]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and remove everything that led to it."""
        written = work_table(df, name)
        for path in self._paths:
            remove_folder(self._spark, path.rsplit("/", 1)[0])
        self._paths.clear()
        return written


def filtered(df: DataFrame, keeps: Callable[[list[str]], np.ndarray], text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts (null: empty) `keeps` tells to keep; nothing is shuffled."""
    place = df.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in column_slices(batches, place):
            yield batch.filter(pa.array(keeps(texts), pa.bool_()))

    return df.mapInArrow(task, df.schema)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a number for each row, the same whenever it is read, and the name of that column.

    Rows of Parquet files are numbered by their file and their place in it, which does not depend on how the files are
    split. Other tables are written down with their numbers, as numbers given in two readings differ when rows are dealt
    out otherwise in the second. The name is a new one, so that no column of the table is hidden.
    """
    name, path = f"row_{uuid.uuid4().hex}", f"path_{uuid.uuid4().hex}"
    if not _reads_parquet(df):
        return work_table(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    placed = df.select(*own, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    # One row per file.
    files = sorted(r[0] for r in placed.select(path).distinct().collect())
    listed = df.sparkSession.createDataFrame([(f, i << FILE_BITS) for i, f in enumerate(files)], f"{path} string, first long")
    joined = placed.withColumnRenamed(name, f"{name}_").join(F.broadcast(listed.withColumnRenamed("first", f"{name}_first")), path)
    return joined.select(*own, (F.col(f"{name}_first") + F.col(f"{name}_")).alias(name)), name


def _reads_parquet(df: DataFrame) -> bool:
    """Whether the plan is a scan of Parquet files with columns chosen and rows filtered the same way each time."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.children().isEmpty() and "parquet" in node.simpleString(1_000).lower() and "relation" in node.nodeName().lower()


def without_rows(held: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The numbered table without the rows named by the one column of `dropped`, and without their numbers.

    The dropped numbers are written down first: Spark then knows their size, and sends them to the documents while they
    are few, else it joins by a shuffle.
    """
    return held.join(work_table(dropped.toDF(row), "dropped"), row, "left_anti").drop(row)


def slices(sizes: Sequence[int] | np.ndarray, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters each, one row at least."""
    begin, held = 0, 0
    for i, size in enumerate(np.asarray(sizes, np.int64).tolist()):
        held += size + 1
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def column_slices(
    batches: Iterable[pa.RecordBatch], text: int = 1, most: int = BATCH_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut to a bounded number of characters, with their texts (null: empty) as a list.

    Only the texts of one cut are Python objects at a time.
    """
    for batch in batches:
        column = batch.column(text)
        size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
        for begin, end in slices(size, most):
            yield batch.slice(begin, end - begin), [x or "" for x in column.slice(begin, end - begin).to_pylist()]


def take_runs(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of flat[b : b + n] for each b of begin and n of length."""
    if len(length) and not length.all():
        some = np.flatnonzero(length)
        begin, length = begin[some], length[some]
    if not len(length):
        return flat[:0]
    begin, length = begin.astype(np.int64, copy=False), length.astype(np.int64, copy=False)
    stop = np.cumsum(length)
    # From one id to the next it is one step, but where a run begins.
    step = np.ones(stop[-1], np.int64)
    step[0] = begin[0]
    step[stop[:-1]] = begin[1:] - begin[:-1] - length[:-1] + 1
    return flat.take(np.cumsum(step, out=step))


def starts(length: np.ndarray) -> np.ndarray:
    """Exclusive running totals."""
    out = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=out[1:])
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join each row to the one row of its group, without bringing a large group to one task.

    `groups` has one row per key and the number of its rows in `size`. Keys with more than total / HOT_PART
    rows, of which there are fewer than HOT_PART, are broadcast; the others are joined by a shuffle.
    """
    hot = F.col(size) > F.lit(max(1, total // HOT_PART))
    names = [c for c in groups.columns if c != key]
    common = F.broadcast(groups.filter(hot).select(key, F.struct(*names).alias("hot")))
    rare = groups.filter(~hot).select(key, F.struct(*names).alias("rare"))
    marked = rows.join(common, key, "left")
    found = marked.filter("hot is not null").select(*rows.columns, "hot.*")
    rest = marked.filter("hot is null").drop("hot").join(rare, key).select(*rows.columns, "rare.*")
    return found.unionByName(rest)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part`; ids that are null count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def release_others(owner: str) -> None:
    """Release what another `owner` left in this Python worker; from now on it keeps the objects of `owner`."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):  # else freed arrays stay with the worker
            _LIBC.malloc_trim(0)


def map_large_blocks() -> None:
    """Have the C library map large blocks of this Python worker by themselves, so that they go when they are freed.

    Else it takes the blocks of later Arrow batches from its heap, as soon as one as large was freed, and small blocks
    that are put behind them keep their places from going back.
    """
    if hasattr(_LIBC, "mallopt"):
        for parameter, size in HEAP_BOUNDS.items():
            _LIBC.mallopt(parameter, size)


def once_per_worker(owner: str, make: Callable, *key: object, using: tuple = ()) -> object:
    """make(*key, *using), kept under its key for later tasks of the same Python worker.

    Workers outlive operators, so what another `owner` left is released first; of one owner the last few are kept.
    """
    name = (make.__module__, make.__qualname__, *key)
    release_others(owner)
    if name not in _KEPT:
        while len(_KEPT) > MOST_KEPT:
            del _KEPT[next(k for k in _KEPT if k != "owner")]
        _KEPT[name] = make(*key, *using)
    return _KEPT[name]


_KEPT: dict[object, object] = {}
_LIBC = ctypes.CDLL(None)
