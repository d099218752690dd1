"""Feature transformations, each split into a fit and an apply step.

A transformation states what it must know about the table (``needs``); ``fit`` gathers the needs
of several independent steps in one aggregate and turns them into a small, JSON-ready state.
``apply`` is a plain projection, so a fitted step also runs on new or streaming data.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError
from featurespark.functions.columns import DATETIME, STRING, field_of, is_numeric, number_of, ref, type_class, value_of
from featurespark.functions.numeric import bin_index, distinct_edges, equal_width_edges
from featurespark.operators.quantiles import exact_quantiles
from featurespark.operators.value_counts import most_frequent
from featurespark.session import cut_lineage


@dataclass
class Needs:
    """What a fit must read: aggregates by name, medians, most frequent values, and value lists with their limits."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    medians: list[str] = field(default_factory=list)
    modes: list[str] = field(default_factory=list)
    values: dict[str, int | None] = field(default_factory=dict)


@dataclass
class Found:
    """The answers to ``Needs``."""

    aggregates: dict[str, Any] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, Any] = field(default_factory=dict)
    values: dict[str, list[tuple[Any, str]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Fitted:
    """A transformation ready to be applied; ``to_json`` and ``from_json`` store it."""

    operation: str
    params: dict[str, Any]
    state: dict[str, Any]

    def to_json(self) -> str:
        return json.dumps({"operation": self.operation, "params": self.params, "state": self.state})

    @staticmethod
    def from_json(text: str) -> Fitted:
        return Fitted(**json.loads(text))


class Transformation:
    """Base class: override ``inputs`` and ``columns``, and ``check``, ``needs`` and ``finish`` where they apply."""

    def inputs(self, params: dict[str, Any]) -> list[str]:
        return [_param(params, "column")]

    def outputs(self, params: dict[str, Any]) -> list[str] | None:
        """Names of the written columns; None if they are known only after the fit."""
        return None

    def check(self, schema: T.StructType, params: dict[str, Any]) -> None:
        for name in self.inputs(params):
            field_of(schema, name)

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        return Needs()

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        return {}

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        raise NotImplementedError

    def fit(self, df: DataFrame, params: dict[str, Any]) -> Fitted:
        return fit_steps(df, [(self, self.operation, params)])[0]

    def __call__(self, df: DataFrame, params: dict[str, Any]) -> DataFrame:
        return apply_fitted(df, self.fit(df, params))

    operation: str = ""


class WholeTableFunction(Transformation):
    """A registered plain function ``(df, params) -> df``; ``reads`` names the parameters that hold its input columns."""

    def __init__(self, function: Callable[[DataFrame, dict[str, Any]], DataFrame], reads: Sequence[str] = ()) -> None:
        self.function, self.reads = function, tuple(reads)

    @property
    def declared(self) -> bool:
        return bool(self.reads)

    def inputs(self, params: dict[str, Any]) -> list[str]:
        return [params[key] for key in self.reads or ("column",) if key in params]

    def __call__(self, df: DataFrame, params: dict[str, Any]) -> DataFrame:
        return self.function(df, params)


# Text of an error.
UNKNOWN_NAME = "Unknown transformation '{}'. Available: {}"


class Catalogue(dict):
    """Transformations by name."""

    def __missing__(self, name: str) -> Transformation:
        raise DataAccessError(UNKNOWN_NAME.format(name, sorted(self)))

    def adder(self, name: str, reads: Sequence[str]):
        def add(target):
            self[name] = target() if isinstance(target, type) else WholeTableFunction(target, reads)
            self[name].operation = name
            return target

        return add


CATALOGUE = Catalogue()


def register(name: str, reads: Sequence[str] = ()):
    """Add a ``Transformation`` subclass or a function ``(df, params) -> df`` under a name.

    A function on a guarded table has to say in ``reads`` which parameters name the columns that it looks at.
    """
    return CATALOGUE.adder(name, reads)


def get_transformation(name: str) -> Transformation:
    return CATALOGUE[name]


def list_transformations() -> list[str]:
    return sorted(CATALOGUE)


def _param(params: dict[str, Any], key: str) -> Any:
    if key not in params:
        raise DataAccessError(f"missing parameter '{key}'")
    return params[key]


def _numeric_input(schema: T.StructType, name: str) -> Column:
    member = field_of(schema, name)
    if not is_numeric(member) and not isinstance(member.dataType, T.BooleanType):
        raise DataAccessError(f"Column '{name}' is not numeric")
    return number_of(member)


class _NumericTransformation(Transformation):
    def check(self, schema: T.StructType, params: dict[str, Any]) -> None:
        for name in self.inputs(params):
            _numeric_input(schema, name)


def fit_steps(df: DataFrame, steps: Sequence[tuple[Transformation, str, dict[str, Any]]]) -> list[Fitted]:
    """Fit steps that do not read each other's output; their aggregates share one scan."""
    schema = df.schema
    wanted = []
    for step, _, params in steps:
        step.check(schema, params)
        wanted.append(step.needs(schema, params))
    aggregates = {
        (index, key): column for index, need in enumerate(wanted) for key, column in need.aggregates.items()
    }
    answers: dict[tuple[int, str], Any] = {}
    if aggregates:
        row = df.agg(*[column.alias(f"a{position}") for position, column in enumerate(aggregates.values())]).first()
        answers = {key: row[position] for position, key in enumerate(aggregates)}
    medians = {name: [0.5] for need in wanted for name in need.medians}
    middle = {name: found.get(0.5) for name, found in exact_quantiles(df, medians).items()}
    modes = {}
    for name in dict.fromkeys(name for need in wanted for name in need.modes):
        best = most_frequent(df, name).first()
        modes[name] = best["value"] if best is not None else None
    values: dict[str, list[tuple[Any, str]]] = {}
    for need in wanted:
        for name, limit in need.values.items():
            values[name] = _distinct_values(df, name, limit)
    fitted = []
    for index, (step, operation, params) in enumerate(steps):
        _check_outputs(schema, step, params)
        found = Found({key: value for (i, key), value in answers.items() if i == index}, middle, modes, values)
        fitted.append(Fitted(operation, dict(params), step.finish(schema, params, found)))
    return fitted


def _check_outputs(schema: T.StructType, step: Transformation, params: dict[str, Any]) -> None:
    """An output may replace a column of exactly its name, not one that differs by case only."""
    exact = set(schema.fieldNames())
    known = {name.lower(): name for name in exact}
    for output in step.outputs(params) or ():
        if output not in exact and output.lower() in known:
            raise DataAccessError(f"Column '{output}' would replace '{known[output.lower()]}'")


def _distinct_values(df: DataFrame, name: str, limit: int | None) -> list[tuple[Any, str]]:
    """Sorted distinct values with their text; more than a given ``limit`` is an error, never a cut-off list."""
    member = field_of(df.schema, name)
    if type_class(member) == "unknown":
        raise DataAccessError(f"Column '{name}' has no values to encode")
    value = value_of(member)
    distinct = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    listed = distinct.select("value", F.col("value").cast("string").alias("text"))
    rows = (listed if limit is None else listed.limit(limit + 1)).collect()  # they become columns of the schema
    if limit is not None and len(rows) > limit:
        raise DataAccessError(f"Column '{name}' has more than {limit} distinct values; raise 'max_values' to encode it")
    return sorted((row["value"], row["text"]) for row in rows)


def value_dictionary(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column with the number of their one-hot position: (value, position).

    For columns with too many values for one column each; the dictionary stays a table. Positions follow the sorted
    values: they are ranked within ranges, and only the sizes of the ranges meet in one place.
    """
    value = value_of(field_of(df.schema, name))
    distinct = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    own = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = ranged.withColumn("own", own).join(F.broadcast(sizes), "part")
    return ranked.select("value", (F.col("own") - 1 + F.col("before")).alias("position"))


def one_hot_positions(df: DataFrame, name: str, dictionary: DataFrame | None = None) -> DataFrame:
    """The table with `<name>_position`, where its one-hot row has its one; null for missing or unknown values.

    Values are first counted, and those with more than one row in a thousand, at most a thousand, are looked up in a
    broadcast table, so that no value gathers its rows in one task.
    """
    found = value_dictionary(df, name) if dictionary is None else dictionary
    value, output = value_of(field_of(df.schema, name)), f"{name}_position"
    hot_value, hot_place, own_value, place = (f"one_hot_{uuid.uuid4().hex}" for _ in range(4))
    total = df.count()
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").count()
    hot = counts.where(F.col("count") > max(1, total // 1_000)).select("value")
    common = found.join(hot, "value", "left_semi").select(F.col("value").alias(hot_value), F.col("position").alias(hot_place))
    marked = df.join(F.broadcast(common), value == F.col(hot_value), "left")
    rest = marked.where(F.col(hot_place).isNull()).drop(hot_value, hot_place)
    rare = rest.join(found.toDF(own_value, place), value == F.col(own_value), "left").drop(own_value)
    often = marked.where(F.col(hot_place).isNotNull()).withColumn(place, F.col(hot_place)).drop(hot_value, hot_place)
    return often.unionByName(rare).withColumnRenamed(place, output)


def one_hot_vectors(df: DataFrame, name: str, dictionary: DataFrame | None = None) -> DataFrame:
    """The table with `<name>_vector`, its one-hot row in sparse form: (size, indices, values).

    `size` is the number of values in the dictionary; a missing or unknown value has no index. The form for columns
    with very many values.
    """
    found = value_dictionary(df, name) if dictionary is None else dictionary
    size, position, output = found.count(), F.col(f"`{name}_position`"), f"{name}_vector"
    sparse = F.struct(
        F.lit(size).cast("bigint").alias("size"),
        F.array_compact(F.array(position)).alias("indices"),
        F.array_compact(F.array(F.when(position.isNotNull(), F.lit(1.0)))).alias("values"),
    )
    return one_hot_positions(df, name, found).withColumn(output, sparse).drop(f"{name}_position")


def cased_name(text: str) -> str:
    """A name that tells upper from lower case though names are compared without it: `^` before what is not lower.

    `plain_name` takes it back; a `^` of the text becomes two.
    """
    return "".join("^^" if c == "^" else c if c == c.lower() else f"^{c}" for c in text)


def plain_name(name: str) -> str:
    return re.sub(r"\^(.)", r"\1", name, flags=re.DOTALL)


def fitted_columns(schema: T.StructType, fitted: Fitted) -> dict[str, Column]:
    return get_transformation(fitted.operation).columns(schema, fitted.params, fitted.state)


def apply_fitted(df: DataFrame, *steps: Fitted) -> DataFrame:
    """Apply fitted steps in order; each is a projection without a job."""
    for step in steps:
        df = df.withColumns(fitted_columns(df.schema, step))
    return df


def transform(df: DataFrame, name: str, params: dict[str, Any]) -> DataFrame:
    """Fit and apply one registered transformation."""
    return get_transformation(name)(df, params)


@register("fill_missing")
class FillMissing(Transformation):
    """Replace missing values in place by the median (default), mean, mode or a constant."""

    STRATEGIES = ("median", "mean", "mode", "constant")

    def _strategy(self, params: dict[str, Any]) -> str:
        strategy = params.get("strategy", "median")
        if strategy not in self.STRATEGIES:
            raise DataAccessError(f"Unknown fill strategy '{strategy}'")
        return strategy

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return self.inputs(params)

    def check(self, schema: T.StructType, params: dict[str, Any]) -> None:
        member = field_of(schema, _param(params, "column"))
        strategy = self._strategy(params)
        if strategy in ("median", "mean") and not is_numeric(member):
            raise DataAccessError(f"Column '{member.name}' is not numeric and has no {strategy}")
        if strategy == "constant":
            self._constant(member, params.get("value", 0))

    @staticmethod
    def _constant(member: T.StructField, value: Any) -> Column:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if is_numeric(member) and not number:
            raise DataAccessError(f"Column '{member.name}' is numeric and cannot be filled with {value!r}")
        if isinstance(member.dataType, T.BooleanType) and not isinstance(value, bool):
            raise DataAccessError(f"Column '{member.name}' is boolean and cannot be filled with {value!r}")
        if is_numeric(member) and isinstance(member.dataType, T.IntegralType) and float(value) != int(value):
            return F.lit(float(value))
        if is_numeric(member) or isinstance(member.dataType, T.BooleanType):
            return F.lit(value)
        if not isinstance(member.dataType, T.StringType):
            spark = SparkSession.active()
            read = spark.range(1).select(F.lit(str(value)).try_cast(member.dataType).alias("v")).first()["v"]
            if read is None:
                raise DataAccessError(f"Column '{member.name}' cannot be filled with {value!r}")
        return F.lit(str(value)).cast(member.dataType)

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        name, strategy = params["column"], self._strategy(params)
        if strategy == "median":
            return Needs(medians=[name])
        if strategy == "mean":
            return Needs(aggregates={"mean": F.avg(number_of(field_of(schema, name)))})
        if strategy == "mode":
            return Needs(modes=[name])
        return Needs()

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        name, strategy = params["column"], self._strategy(params)
        if strategy == "median":
            return {"number": found.medians[name]}
        if strategy == "mean":
            return {"number": found.aggregates["mean"]}
        if strategy == "mode":
            best = found.modes[name]
            return {"text": "0" if best is None else _literal_text(best)}
        return {}

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        name = params["column"]
        member = field_of(schema, name)
        if "number" in state:
            filled = F.coalesce(number_of(member), F.lit(state["number"]).cast("double"))
        elif "text" in state:
            filled = F.coalesce(value_of(member), F.lit(state["text"]).try_cast(member.dataType))
        else:
            filled = F.coalesce(value_of(member), self._constant(member, params.get("value", 0)))
        return {name: filled}


def _literal_text(value: Any) -> str:
    """Text that casts back to the value."""
    if isinstance(value, bool):
        return str(value).lower()
    return repr(value) if isinstance(value, float) else str(value)


@register("log_transform")
class LogTransform(_NumericTransformation):
    """log(1 + x) with negative values read as 0."""

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return [params.get("new_column", f"{params['column']}_log")]

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        name = params["column"]
        number = _numeric_input(schema, name)
        value = F.when(number.isNotNull(), F.log1p(F.greatest(number, F.lit(0.0))))
        return {self.outputs(params)[0]: value}


@register("ratio")
class Ratio(_NumericTransformation):
    """Numerator over denominator, null where the denominator is 0."""

    def inputs(self, params: dict[str, Any]) -> list[str]:
        return [_param(params, "numerator"), _param(params, "denominator")]

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return [params.get("new_column", "_over_".join(self.inputs(params)))]

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        above, below = self.inputs(params)
        denominator = _numeric_input(schema, below)
        value = _numeric_input(schema, above) / F.when(denominator != 0, denominator)
        return {self.outputs(params)[0]: value}


@register("standard_scale")
class StandardScale(_NumericTransformation):
    """(x - mean) / standard deviation; a constant column is only centred."""

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return [f"{params['column']}_scaled"]

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        number = _numeric_input(schema, params["column"])
        return Needs(aggregates={"mean": F.avg(number), "std": F.stddev_samp(number)})

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        return dict(found.aggregates)

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        name = params["column"]
        mean, std = (F.lit(state[key]).cast("double") for key in ("mean", "std"))
        divisor = F.lit(1.0) if state["std"] == 0 else std
        return {self.outputs(params)[0]: (_numeric_input(schema, name) - mean) / divisor}


@register("one_hot_encode")
class OneHotEncode(Transformation):
    """One boolean column per distinct value, in sorted order; a missing value is false everywhere.

    The values are all that occur, or the given ``values``; ``max_values`` refuses columns with more. Values that
    differ by case only get names that say so, see ``cased_name``. For columns with very many values use
    ``one_hot_vectors`` or ``one_hot_positions``.
    """

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        if "values" in params:
            return Needs()
        limit = params.get("max_values")
        return Needs(values={params["column"]: None if limit is None else int(limit)})

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        name = params["column"]
        values = [(v, _literal_text(v)) for v in params["values"]] if "values" in params else found.values[name]
        taken = {column.lower() for column in schema.fieldNames()}
        folded = Counter(str(value).lower() for value, _ in values)  # column names ignore case
        outputs = []
        for value, text in values:
            shown = str(value)
            if folded[shown.lower()] > 1 or (f"{name}_{value}".lower() in taken and shown != shown.lower()):
                shown = cased_name(shown)
            output = f"{name}_{shown}"
            if output.lower() in taken:
                raise DataAccessError(f"Column '{output}' exists already, or differs from another by case only")
            taken.add(output.lower())
            outputs.append([output, text])
        return {"outputs": outputs}

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        member = field_of(schema, params["column"])
        value = value_of(member)
        return {
            output: F.coalesce(value == F.lit(text).cast(member.dataType), F.lit(False))
            for output, text in state["outputs"]
        }


@register("binning")
class Binning(_NumericTransformation):
    """Zero-based right-closed bin: ``bins`` equal widths (default 5), or a list of edges."""

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return [f"{params['column']}_bin"]

    def check(self, schema: T.StructType, params: dict[str, Any]) -> None:
        super().check(schema, params)
        bins = params.get("bins", 5)
        if isinstance(bins, (list, tuple)):
            distinct_edges(bins)
        elif isinstance(bins, bool) or not isinstance(bins, int) or bins < 1:
            raise DataAccessError("bins must be a positive integer or a list of edges")

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        if isinstance(params.get("bins", 5), (list, tuple)):
            return Needs()
        number = _numeric_input(schema, params["column"])
        return Needs(aggregates={"rows": F.count("*"), "least": F.min(number), "greatest": F.max(number)})

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        bins = params.get("bins", 5)
        if isinstance(bins, (list, tuple)):
            return {"edges": distinct_edges(bins)}
        if not found.aggregates["rows"]:
            raise DataAccessError("an empty table has no equal-width bins")
        least, greatest = found.aggregates["least"], found.aggregates["greatest"]
        return {"edges": [] if least is None else equal_width_edges(least, greatest, bins)}

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        name = params["column"]
        return {self.outputs(params)[0]: bin_index(_numeric_input(schema, name), state["edges"])}


# Formats of dates in text that are tried when none is given, ISO first.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy",
    "MM-dd-yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd", "MMM d, yyyy",
    "d MMM yyyy",
)


@register("date_features")
class DateFeatures(Transformation):
    """Year, month and day of week (Monday = 0) of a date, timestamp or text; unreadable text gives null.

    Text is read by the given ``format``, or else by the one of ISO form and DATE_FORMATS that reads most values,
    the first of equals.
    """

    def outputs(self, params: dict[str, Any]) -> list[str]:
        return [f"{params['column']}_{part}" for part in ("year", "month", "dayofweek")]

    def check(self, schema: T.StructType, params: dict[str, Any]) -> None:
        member = field_of(schema, _param(params, "column"))
        if type_class(member) not in (STRING, DATETIME):
            raise DataAccessError(f"Column '{member.name}' is neither text nor a date")
        if params.get("format") is not None:
            try:
                SparkSession.active().range(1).select(F.date_format(F.current_timestamp(), params["format"])).first()
            except Exception as error:
                raise DataAccessError(f"'{params['format']}' is no date format") from error

    @staticmethod
    def _moment(name: str, given: str | None) -> Column:
        return ref(name).try_cast("timestamp_ntz") if given is None else F.try_to_timestamp(ref(name), F.lit(given))

    def needs(self, schema: T.StructType, params: dict[str, Any]) -> Needs:
        name = params["column"]
        if type_class(field_of(schema, name)) != STRING or params.get("format") is not None:
            return Needs()
        tried = {form or "": F.count(self._moment(name, form)) for form in (None, *DATE_FORMATS)}
        return Needs(aggregates=tried)

    def finish(self, schema: T.StructType, params: dict[str, Any], found: Found) -> dict[str, Any]:
        if not found.aggregates:
            return {"format": params.get("format")}
        return {"format": max(found.aggregates, key=found.aggregates.get) or None}

    def columns(self, schema: T.StructType, params: dict[str, Any], state: dict[str, Any]) -> dict[str, Column]:
        name = params["column"]
        moment = ref(name)
        if type_class(field_of(schema, name)) == STRING:
            moment = self._moment(name, state.get("format"))
        return dict(zip(self.outputs(params), (F.year(moment), F.month(moment), F.weekday(moment))))
