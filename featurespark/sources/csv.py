"""CSV files with a header, missing-value words and type inference; quoted line breaks don't keep a file in one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError
from featurespark.functions.columns import ref
from featurespark.session import cut_lineage

# Words read as missing, as pandas reads them by default.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"

#: What a line range holds besides whole records: the end of one that began before, its middle, or the begin of one.
END, MIDDLE, BEGIN, WHOLE = range(4)


def _number(text: Column) -> Column:
    sign = F.when(F.trim(text).startswith("-"), -1.0).otherwise(1.0)
    return F.when(text.rlike(_INFINITE), sign * F.lit(float("inf"))).otherwise(text.try_cast("double"))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    missing_words=MISSING_WORDS,
    multi_line: bool = True,
    **options: str,
) -> DataFrame:
    """Read CSV with a header line.

    With a schema its columns are taken by their names in the header, whatever their order there; a name that the
    header lacks is an error. Without one, an aggregate over all rows picks for every column the first of integer,
    double, boolean and text that reads each of its values; dates stay text.

    Values in quotes may hold line breaks. Files are read in byte ranges all the same, see `split_records`; only files
    with quotes inside of plain values, and readings with `options` other than a separator, are read by one task a
    file. `multi_line=False` says that no value holds a line break. `options` go to Spark's reader.
    """
    given = {"header": "true", "escape": '"', **options}
    names = spark.read.options(**given, multiLine=str(multi_line).lower()).csv(path).columns
    split = split_records(spark, path, options.get("sep", ",")) if multi_line and set(options) <= {"sep"} else None
    if split is None:
        text = spark.read.options(**given, multiLine=str(multi_line).lower()).csv(path)
    elif isinstance(split, bool):
        text = spark.read.options(**given, multiLine="false").csv(path)
    else:
        cells = T.StructType([T.StructField(f"c{index}", T.StringType()) for index in range(len(names))])
        parsed = F.from_csv("value", cells.simpleString()[len("struct<") : -1].replace(":", " "), given | {"header": "false", "multiLine": "true"})
        text = split.select(parsed.alias("cells")).select("cells.*").toDF(*names)
    if schema is not None:
        target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        unknown = [field.name for field in target.fields if field.name not in text.columns]
        if unknown:
            raise DataAccessError(f"Columns {unknown} are not in the header {text.columns}")
        return text.select(
            *[_present(field.name, missing_words).cast(field.dataType).alias(field.name) for field in target.fields]
        )
    text = text.select(*[_present(name, missing_words).alias(name) for name in text.columns])
    kinds = inferred_kinds(text)
    readers = {
        "integer": lambda value: value.try_cast("bigint"),
        "double": _number,
        "boolean": lambda value: F.lower(value).cast("boolean"),
        "text": lambda value: value,
    }
    return text.select(*[readers[kinds[name]](ref(name)).alias(name) for name in text.columns])


def inferred_kinds(text: DataFrame) -> dict[str, str]:
    """The first of integer, double, boolean and text that reads every value of a text column, in one read.

    Columns are stacked, so that the patterns are compiled once however many there are; each task sends a row per
    column. A column without values is double.
    """
    cells = F.array(*[ref(name) for name in text.columns])
    value = F.col("value")
    long = text.select(F.posexplode(cells).alias("column", "value")).where(value.isNotNull())
    integer = value.rlike(_INTEGER) & value.try_cast("bigint").isNotNull()
    number = value.rlike(_NUMBER) | value.rlike(_INFINITE)
    found = long.groupBy("column").agg(
        F.bool_and(integer).alias("integer"), F.bool_and(number).alias("double"),
        F.bool_and(value.rlike(_BOOLEAN)).alias("boolean"),
    )
    kinds = {name: "double" for name in text.columns}
    for row in found.collect():  # one row per column
        kinds[text.columns[row["column"]]] = next((k for k in ("integer", "double", "boolean") if row[k]), "text")
    return kinds


def split_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame | bool | None:
    """The records of CSV files after their headers, as rows (value), from byte ranges that are read independently.

    A line break belongs to a value when an odd number of quotes stands before it. The quotes of each range are
    counted first; their running sums, one number per range, tell in which state each range begins. A range then
    gives out the records that begin and end in it, and the pieces of records that reach into others, which are put
    together by their order. True when no file has a quote, so that lines are records; None when a quote stands where
    this rule of quotes doesn't hold, as inside of a plain value.
    """
    mark = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", mark["file_path"].alias("file"), mark["file_block_start"].alias("start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "start", "quotes", F.coalesce(F.sum("quotes").over(order), F.lit(0)).alias("before"))
    ranges = before.collect()  # one row per byte range
    if not any(row["quotes"] for row in ranges):
        return True
    totals: dict[str, int] = {}
    for row in ranges:
        totals[row["file"]] = totals.get(row["file"], 0) + row["quotes"]
    if any(total % 2 for total in totals.values()):
        return None
    inside = spark.sparkContext.broadcast({(row["file"], row["start"]) for row in ranges if row["before"] % 2})
    cell = rf'(?:"(?:[^"]|"")*"|[^"{re.escape(separator)}]*)'
    sound = re.compile(rf"{cell}(?:{re.escape(separator)}{cell})*\r?", re.DOTALL)

    def cut(batches, whole):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = inside.value
        now, opened, head, first, buffer = None, False, False, False, []

        def rest():
            """What is open at the end of a range."""
            return [("\n".join(buffer), *now, MIDDLE if head else BEGIN, first, False)] if buffer else []

        for batch in batches:
            if whole and not opened and not first and batch.num_rows and not buffer:
                same = now == (batch.column(1)[0].as_py(), batch.column(2)[0].as_py()) and len(pc.unique(batch.column(2))) == 1
                if same and len(pc.unique(batch.column(1))) == 1 and not pc.any(pc.match_substring(batch.column(0), '"')).as_py():
                    yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
                    continue
            out = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != now:
                    if now is not None:
                        out += rest()
                    now = file, start
                    opened = head = now in held
                    first, buffer = start == 0, []
                buffer.append(line)
                if line.count('"') % 2:
                    opened = not opened
                if not opened:
                    text = "\n".join(buffer)
                    plain = '"' not in text or sound.fullmatch(text) is not None
                    # The first record of a file is its header.
                    if head or not plain or not first:
                        out.append((text, *now, END if head else WHOLE, False, not head and not plain))
                    first = first and head
                    head, buffer = False, []
            yield from given(out, whole)
        if now is not None:
            yield from given(rest(), whole)

    def given(rows, whole):
        import pyarrow as pa

        if whole:
            values = [row[0] for row in rows if row[3] == WHOLE]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
            return
        kept = [row for row in rows if row[3] != WHOLE or row[5]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
        columns = zip(*kept) if kept else [[]] * len(kinds)
        names = ["value", "file", "start", "kind", "header", "unsound"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "value string, file string, start bigint, kind int, header boolean, unsound boolean"
    pieces = cut_lineage(lines.mapInArrow(lambda batches: cut(batches, False), schema))
    if pieces.where("unsound").take(1):
        return None
    number = F.count_if(F.col("kind") == BEGIN).over(Window.partitionBy("file").orderBy("start", "kind"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "kind", "value")))
    joined = pieces.withColumn("record", number).groupBy("file", "record").agg(
        F.array_join(F.transform(ordered, lambda piece: piece["value"]), "\n").alias("value"), F.bool_or("header").alias("header")
    )
    # A record of pieces is checked like the others; the pattern means the same to both engines.
    across = joined.where(~F.col("header"))
    if across.where(~F.col("value").rlike(f"^(?s:{sound.pattern})$")).take(1):
        return None
    records = lines.mapInArrow(lambda batches: cut(batches, True), "value string").unionByName(across.select("value"))
    # Spark's reader gives line breaks in values as \n as well.
    value = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    return records.select(value.alias("value")).where("value <> ''")


def _present(name: str, missing_words) -> Column:
    return F.when(~ref(name).isin(*missing_words), ref(name))
