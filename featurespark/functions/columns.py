"""Column references, type classes and the missing-value rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError

INTEGER, FLOAT, BOOLEAN = "integer", "float", "boolean"
STRING, CATEGORICAL, DATETIME, UNKNOWN = "string", "categorical", "datetime", "unknown"


def ref(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_of(schema: T.StructType, name: str) -> T.StructField:
    for field in schema.fields:
        if field.name == name:
            return field
    raise DataAccessError(f"Unknown column '{name}'")


def type_class(field: T.StructField) -> str:
    """The seven type classes of a profile; categorical only where the field metadata says so."""
    if field.metadata.get("categorical"):
        return CATEGORICAL
    kind = field.dataType
    if isinstance(kind, T.IntegralType):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return UNKNOWN


def is_numeric(field: T.StructField) -> bool:
    return type_class(field) in (INTEGER, FLOAT)


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer and floating columns in table order; booleans are not numeric."""
    return [field.name for field in df.schema.fields if is_numeric(field)]


def value_of(field: T.StructField) -> Column:
    """The column with NaN read as missing, as every operator here does."""
    column = ref(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(column, F.lit(None).cast(field.dataType))
    return column


def number_of(field: T.StructField) -> Column:
    """A numeric or boolean column as double, NaN read as missing."""
    if isinstance(field.dataType, T.BooleanType):
        return ref(field.name).cast("int").cast("double")
    return value_of(field).cast("double")


def chunks(items: list, size: int) -> list[list]:
    return [items[start : start + size] for start in range(0, len(items), size)]
