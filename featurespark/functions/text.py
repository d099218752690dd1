"""Text forms of values, and the token estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.functions.columns import ref


def double_text(number: Column) -> Column:
    """Shortest decimal text in Python's layout: fixed from 1e-4 up to 1e16, else 1e+16 or 1e-05.

    Spark writes 1.0E7 and 1.0E-4. The parts of the text are bound by lambdas, so each is
    worked out once.
    """

    def parts(text: Column) -> Column:
        body = F.regexp_replace(text, "^-", "")
        mantissa = F.split_part(body, F.lit("E"), F.lit(1))
        fraction = F.split_part(mantissa, F.lit("."), F.lit(2))
        return F.struct(
            F.when(text.startswith("-"), "-").otherwise("").alias("sign"),
            body.alias("body"),
            F.split_part(mantissa, F.lit("."), F.lit(1)).alias("whole"),
            F.when(fraction == "0", "").otherwise(fraction).alias("fraction"),
            F.split_part(body, F.lit("E"), F.lit(2)).try_cast("int").alias("exponent"),
        )

    def layout(part: Column) -> Column:
        exponent, fraction = part["exponent"], part["fraction"]
        digits = F.concat(part["whole"], fraction)
        padded = F.rpad(digits, F.greatest(F.length(digits), exponent + 1), F.lit("0"))
        after_point = F.substr(padded, exponent + 2)
        large = F.concat(F.left(padded, exponent + 1), F.lit("."), F.when(after_point == "", "0").otherwise(after_point))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        size = F.abs(exponent).cast("string")
        scientific = F.concat(
            part["whole"],
            F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
            F.when(exponent < 0, "e-").otherwise("e+"),
            F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")),
        )
        text = (
            F.when(part["body"] == "Infinity", "inf")
            .when(part["body"] == "NaN", "nan")
            .when(exponent.isNull(), part["body"])
            .when((exponent >= 0) & (exponent < 16), large)
            .when((exponent < 0) & (exponent >= -4), small)
            .otherwise(scientific)
        )
        return F.concat(part["sign"], text)

    texts = F.array_compact(F.array(number.cast("string")))
    return F.get(F.transform(F.transform(texts, parts), layout), F.lit(0))


def value_text(field: T.StructField) -> Column:
    """A value as shown in previews and as a mode: True/False, Python number layout, JSON for nested values."""
    column = ref(field.name)
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_text(column)
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(column)
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def token_estimate(text: Column, characters_per_token: int = 4) -> Column:
    """Characters divided by four, at least one; a missing text stays missing."""
    tokens = F.floor(F.length(text) / characters_per_token).cast("bigint")
    return F.when(text.isNotNull(), F.greatest(F.lit(1).cast("bigint"), tokens))
