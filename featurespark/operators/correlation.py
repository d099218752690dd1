"""Pearson and Spearman correlation of numeric columns, pairwise complete, undefined values as 0."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError
from featurespark.functions.columns import numeric_columns
from featurespark.operators.gram import pair_correlations
from featurespark.operators.ranks import rank_correlations

HIGH_CORRELATION = 0.85
DIGITS = 6

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("col_a", T.StringType(), False),
        T.StructField("col_b", T.StringType(), False),
        T.StructField("corr", T.DoubleType(), False),
    ]
)


@dataclass(frozen=True)
class CorrelationSummary:
    """Coefficients rounded to six digits; ``matrix`` is empty for fewer than two numeric columns."""

    method: str
    columns: list[str]
    matrix: list[list[float]] = field(default_factory=list)
    high_correlation_pairs: list[tuple[str, str, float]] = field(default_factory=list)

    def pairs(self) -> list[tuple[str, str, float]]:
        """Every cell of the matrix as (col_a, col_b, corr)."""
        return [
            (a, b, self.matrix[i][j]) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns)
        ] if self.matrix else []


def _pairs(df: DataFrame, method: str, columns: Iterable[str] | None) -> tuple[list[str], DataFrame | None]:
    """The numeric columns asked for and, for two or more, rows (a, b, corr) of positions in them."""
    if method not in ("pearson", "spearman"):
        raise DataAccessError(f"Unknown correlation method '{method}'. Available: ['pearson', 'spearman']")
    numeric = numeric_columns(df)
    names = numeric if columns is None else [name for name in columns if name in numeric]
    if len(names) < 2:
        return names, None
    return names, (pair_correlations if method == "pearson" else rank_correlations)(df, names, DIGITS)


def correlate(
    df: DataFrame,
    method: str = "pearson",
    columns: Iterable[str] | None = None,
    high_corr_threshold: float = HIGH_CORRELATION,
) -> CorrelationSummary:
    """Correlation matrix of the numeric columns (booleans left out) and the pairs at or above the threshold.

    The matrix is held by the driver; `correlation_table` is the form for very many columns.
    """
    names, pairs = _pairs(df, method, columns)
    if pairs is None:
        return CorrelationSummary(method, names)
    matrix = [[0.0] * len(names) for _ in names]
    for row in pairs.collect():
        matrix[row["a"]][row["b"]] = row["corr"]
    high = [
        (names[i], names[j], matrix[i][j])
        for i, j in combinations(range(len(names)), 2)
        if abs(matrix[i][j]) >= high_corr_threshold
    ]
    return CorrelationSummary(method, names, matrix, high)


def _named(pairs: DataFrame, names: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(name) for name in names])
    col_a, col_b = (F.coalesce(F.get(listed, F.col(place)), F.lit("")).alias(f"col_{place}") for place in "ab")
    return pairs.select(col_a, col_b, F.coalesce("corr", F.lit(0.0)).alias("corr"))


def correlation_table(df: DataFrame, method: str = "pearson", columns: Iterable[str] | None = None) -> DataFrame:
    """The matrix in long form (col_a, col_b, corr); no rows for fewer than two numeric columns."""
    names, pairs = _pairs(df, method, columns)
    return df.sparkSession.createDataFrame([], PAIR_SCHEMA) if pairs is None else _named(pairs, names)


def high_correlations(
    df: DataFrame,
    method: str = "pearson",
    columns: Iterable[str] | None = None,
    high_corr_threshold: float = HIGH_CORRELATION,
) -> DataFrame:
    """Pairs whose rounded coefficient reaches the threshold in absolute value, in column order."""
    names, pairs = _pairs(df, method, columns)
    if pairs is None:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    high = pairs.where((F.col("a") < F.col("b")) & (F.abs("corr") >= high_corr_threshold))
    return _named(high.orderBy("a", "b"), names)
