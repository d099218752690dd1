"""Column guard, visible projection, capped preview and value samples."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import PolicyViolationError
from featurespark.functions.columns import field_of, ref, value_of
from featurespark.functions.text import value_text

PREVIEW_CAP = 5
SAMPLE_SIZE = 20
#: So many times the sample's rows are looked at first.
HEAD_ROWS = 10


def check_visible(df: DataFrame, columns: Iterable[str], hidden: Collection[str]) -> None:
    """Refuse unknown columns, and blocked or sensitive ones."""
    for name in columns:
        field_of(df.schema, name)
        if name in hidden:
            raise PolicyViolationError(f"Column '{name}' is blocked or sensitive and cannot be accessed")


def visible_columns(df: DataFrame, hidden: Collection[str]) -> list[str]:
    return [name for name in df.columns if name not in hidden]


def preview(
    df: DataFrame,
    columns: Sequence[str],
    max_rows: int | None = None,
    row_cap: int = PREVIEW_CAP,
    hidden: Collection[str] = (),
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """At most ``row_cap`` rows of visible columns as text, missing values as "".

    ``max_rows`` is kept within 0 and the cap. Without ``order_by`` the rows are the first that
    Spark reads.
    """
    check_visible(df, columns, hidden)
    rows = row_cap if max_rows is None else max(0, min(max_rows, row_cap))
    if order_by is not None:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    shown = []
    for name in columns:
        field = field_of(df.schema, name)
        shown.append(F.when(value_of(field).isNull(), "").otherwise(value_text(field)).alias(name))
    return df.limit(rows).select(*shown)


def sample_values(
    df: DataFrame, columns: Iterable[str] | None = None, size: int = SAMPLE_SIZE, order_by: str | None = None
) -> dict[str, list[str]]:
    """The first ``size`` non-missing values of each column as text.

    The first rows serve all columns that have few gaps there. The others are stacked, and every task sends the first
    ``size`` values of each, so that one more read serves them all, however many there are and however sparse.
    """
    names = list(df.columns if columns is None else columns)
    texts = []
    for index, name in enumerate(names):
        field = field_of(df.schema, name)
        texts.append(F.when(value_of(field).isNotNull(), value_text(field)).alias(f"v{index}"))
    ordered = df if order_by is None else df.orderBy(ref(order_by))
    head = ordered.limit(HEAD_ROWS * size).select(*texts).collect()
    found: dict[str, list[str]] = {}
    for index, name in enumerate(names):
        values = [row[index] for row in head if row[index] is not None]
        if len(values) >= size or len(head) < HEAD_ROWS * size:
            found[name] = values[:size]
    sparse = [index for index, name in enumerate(names) if name not in found]
    if sparse:
        place = F.monotonically_increasing_id()
        order = [F.lit(None) if order_by is None else ref(order_by), place]
        rows = df.select(F.array(*[texts[index] for index in sparse]).alias("texts"), *[o.alias(f"o{k}") for k, o in enumerate(order)])
        long = rows.select("o0", "o1", F.posexplode("texts").alias("column", "text")).where("text IS NOT NULL")
        number = F.row_number().over(Window.partitionBy("column").orderBy("o0", "o1"))
        for row in long.withColumn("number", number).where(F.col("number") <= size).collect():
            found.setdefault(names[sparse[row["column"]]], []).append((row["number"], row["text"]))
        for index in sparse:
            found[names[index]] = [text for _, text in sorted(found.get(names[index], []))]
    return {name: found[name] for name in names}


def sample_table(df: DataFrame, samples: dict[str, list[str]], without_text: Collection[str] = ()) -> DataFrame:
    """Samples as a table of text columns, shorter samples filled up with nulls.

    Columns in ``without_text`` were not sampled; they appear as empty boolean columns.
    """
    longest = max((len(values) for values in samples.values()), default=0)
    names = [name for name in df.columns if name in samples or name in without_text]
    rows = [
        tuple(samples[name][index] if index < len(samples.get(name, ())) else None for name in names)
        for index in range(longest)
    ]
    kinds = [T.BooleanType() if name in without_text else T.StringType() for name in names]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds)])
    return df.sparkSession.createDataFrame(rows, schema)
