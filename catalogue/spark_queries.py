"""The registered queries: each runs one operator over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import FeatureSparkError
from featurespark.functions.columns import numeric_columns, value_of
from featurespark.functions.text import token_estimate
from featurespark.operators.budget import budget_select, budget_summary
from featurespark.operators.correlation import correlation_table, high_correlations
from featurespark.operators.duplicates import duplicate_of
from featurespark.operators.profile import profile_table
from featurespark.operators.sensitive import PATTERN_DETECTOR, aggregate_votes, match_ratios
from featurespark.operators.transforms import (
    get_transformation,
    list_transformations,
    one_hot_positions,
    one_hot_vectors,
    transform,
)
from featurespark.operators.visibility import preview, sample_table, sample_values
from featurespark.plans.plan import approved_names, parse_plan, run_plan, run_summary
from featurespark.plans.report import pair_lines, profile_lines
from featurespark.plans.table import TableHandle
from featurespark.session import shared_folder
from featurespark.sources.csv import read_csv
from featurespark.sources.tables import read_table, read_version
from featurespark.streaming.apply import transform_stream, write_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the last bits do not decide a comparison."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/work-{uuid.uuid4()}"


# -- profiles


def _numeric_profile(df: DataFrame) -> DataFrame:
    profile = profile_table(df)
    flat = profile.select(
        "name", "dtype", "null_count", "null_percentage", "unique_count", "cardinality_ratio", "is_constant",
        "mean", "median", "std", "min", "max", "skewness", "kurtosis",
        F.col("quantiles.p25").alias("p25"), F.col("quantiles.p50").alias("p50"), F.col("quantiles.p75").alias("p75"),
    )
    return rounded(flat, DIGITS + 1)  # a mean of two-digit values can end in half a unit of the sixth digit


@query
def profile_numeric(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return _numeric_profile(lineitem.select(*numeric_columns(lineitem)))


@query
def profile_numeric_nulls(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return _numeric_profile(
        lineitem.select(
            F.nullif("l_discount", F.lit(0.0)).alias("discount_or_null"),
            F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax_or_nan"),
            F.lit(2.5).alias("always_the_same"),
        )
    )


@query
def profile_categorical(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(
        "o_orderpriority",
        "o_orderstatus",
        "o_orderdate",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority_or_null"),
        (F.col("o_totalprice") > 250000).alias("is_large"),
    )
    customer = read_table(spark, folder, "customer").select("c_mktsegment", "c_name")
    profiles = profile_table(orders).unionByName(profile_table(customer))
    return profiles.select(
        "name", "dtype", "null_count", "null_percentage", "unique_count", "cardinality_ratio", "is_constant", "mode"
    )


@query
def profile_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of long texts, counted by digest."""
    documents = read_table(spark, folder, "documents").select("text", "lang", "source")
    pages = read_table(spark, folder, "pages").select("url", "html")
    turns = read_table(spark, folder, "conversations").select("role", F.col("text").alias("said"))
    profiles = profile_table(documents).unionByName(profile_table(pages)).unionByName(profile_table(turns))
    return profiles.select(
        "name", "dtype", "null_count", "null_percentage", "unique_count", "cardinality_ratio", "is_constant", "mode"
    )


@query
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    profiles = profile_table(lineitem.select("l_discount", "l_quantity", "l_extendedprice", "l_linenumber"))
    bins = profiles.select(
        "name",
        F.posexplode("histogram_counts").alias("bin", "row_count"),
        "histogram_bins",
    )
    edges = bins.select(
        "name",
        F.col("bin").cast("bigint").alias("bin"),
        F.get("histogram_bins", F.col("bin")).alias("low_edge"),
        F.get("histogram_bins", F.col("bin") + 1).alias("high_edge"),
        "row_count",
    )
    return rounded(edges)


@query
def duplicate_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    orders = orders.withColumns(
        {
            "o_orderkey_copy": F.col("o_orderkey"),
            "o_status_copy": F.col("o_orderstatus"),
            "o_almost": F.when(F.col("o_orderkey") == 7, 8).otherwise(F.col("o_orderkey")),
        }
    )
    rows = list(duplicate_of(orders).items())
    return spark.createDataFrame(rows, "name string, is_duplicate_of string")


@query
def table_metadata(spark: SparkSession, folder: str) -> DataFrame:
    table = TableHandle(read_table(spark, folder, "orders"))
    return table.metadata().select("engine", "row_count", "column_count", "size_bytes", "version")


@query
def table_schema(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").withColumn("large", F.nullif(F.col("value") > 50, F.lit(False)))
    return TableHandle(events, blocked_columns=["props"], order_by="event_id").schema()


@query
def profile_infinite(spark: SparkSession, folder: str) -> DataFrame:
    """A column with both infinities has a range and counts, but no histogram."""
    line = F.col("l_linenumber")
    value = F.when(line == 1, F.lit(float("inf"))).when(line == 2, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    profile = profile_table(read_table(spark, folder, "lineitem").select(value.alias("value")))
    bins = F.size("histogram_bins").cast("bigint").alias("bins")
    return profile.select("name", "null_count", "unique_count", "min", "max", "median", bins)


@query
def profile_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Shape far from zero: the same as without the offset."""
    lines = read_table(spark, folder, "lineitem").select((F.col("l_quantity") + F.lit(1e15)).alias("value"))
    return rounded(profile_table(lines).select("name", "std", "skewness", "kurtosis", "min", "max"), 4)


@query
def single_profile(spark: SparkSession, folder: str) -> DataFrame:
    table = TableHandle(read_table(spark, folder, "events"), order_by="event_id")
    profile = table.column_profile("value")
    return rounded(profile.select("name", "dtype", "null_count", "unique_count", "mean", "median", "std"))


@query
def visible_profile(spark: SparkSession, folder: str) -> DataFrame:
    table = TableHandle(read_table(spark, folder, "events"), order_by="event_id")
    profiles = table.profiles()
    return rounded(profiles.select("name", "dtype", "null_count", "unique_count", "mode", "mean", "min", "max"))


@query
def analyze_events(spark: SparkSession, folder: str) -> DataFrame:
    found = TableHandle(read_table(spark, folder, "events"), order_by="event_id").analyze()
    profiles = found["profiles"].select("name", "unique_count", F.round("mean", DIGITS).alias("mean"))
    metadata = found["metadata"].first()
    return (
        found["schema"]
        .join(profiles, "name", "left")
        .select("name", "dtype", "nullable", "is_pii", "unique_count", "mean")
        .withColumns({"row_count": F.lit(metadata.row_count), "version": F.lit(metadata.version).cast("bigint")})
        .withColumn("row_count", F.col("row_count").cast("bigint"))
    )


# -- projections and samples


@query
def numeric_projection(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer")
    return customer.select(*numeric_columns(customer))


@query
def null_filter(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem").withColumn(
        "discount", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.nullif("l_discount", F.lit(0.0)))
    )
    return lineitem.where(value_of(lineitem.schema["discount"]).isNotNull()).select(
        "l_orderkey", "l_linenumber", "discount"
    )


@query
def visible_projection(spark: SparkSession, folder: str) -> DataFrame:
    return TableHandle(read_table(spark, folder, "events"), blocked_columns=["props"], order_by="event_id").visible()


@query
def capped_preview(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").withColumn("high", F.nullif(F.col("value") > 10, F.lit(False)))
    return preview(events, ["event_id", "ts", "event_type", "value", "high"], max_rows=100, order_by="event_id")


@query
def value_sample(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select(
        "event_id", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("value_or_null")
    )
    samples = sample_values(events, order_by="event_id")
    table = sample_table(events, samples).unpivot([], events.columns, "column", "value")
    return table.where(F.col("value").isNotNull())


# -- sensitive columns


def _contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Events with columns of text in the forms that the detector knows, derived from each row."""
    event, user = F.col("event_id"), F.col("user_id")
    padded = F.lpad(event.cast("string"), 9, "0")
    return read_table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        F.concat(F.lit(" user"), user, F.when(event % 3 == 0, "").otherwise("@example.com"), F.lit("\t")).alias("contact"),
        F.concat(F.lit("+49"), padded).alias("reachable"),
        F.concat(F.substring(padded, 1, 3), F.lit("-"), F.substring(padded, 4, 2), F.lit("-"),
                 F.when(event % 2 == 0, F.substring(padded, 6, 4)).otherwise("x")).alias("number"),
        F.concat(F.lit("10.0."), (user % 256).cast("string"), F.lit("."), (event % 256).cast("string")).alias("source"),
        F.md5(event.cast("string")).alias("digest"),
        F.concat(F.lit("4000 1234 5678 "), F.substring(padded, 6, 4)).alias("paid_with"),
    )


@query
def value_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(match_ratios(_contacts(spark, folder)))


@query
def value_ratio_texts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(match_ratios(read_table(spark, folder, "documents").select("text", "lang", "source")))


@query
def sensitive_columns(spark: SparkSession, folder: str) -> DataFrame:
    votes = aggregate_votes(_contacts(spark, folder))
    return rounded(
        votes.select("column_name", "category", "confidence", "is_sensitive", "recommended_action", "explanation")
    )


@query
def late_sensitive(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses only after the first thousand keys: the whole column is judged."""
    note = F.when(F.col("o_orderkey") <= 1000, "n/a").otherwise(F.concat(F.lit("c"), "o_custkey", F.lit("@example.com")))
    orders = read_table(spark, folder, "orders").select(note.alias("note"), "o_orderstatus")
    table = TableHandle(orders)
    found = rounded(match_ratios(orders).where("category = 'email'").select(F.col("column").alias("name"), "matches", "ratio"))
    return table.schema().select("name", "is_pii").join(found, "name")


@query
def sensitive_by_sample(spark: SparkSession, folder: str) -> DataFrame:
    events = _contacts(spark, folder)
    samples = sample_table(events, sample_values(events, order_by="event_id"))
    return rounded(aggregate_votes(samples).select("column_name", "category", "confidence", "is_sensitive"))


@query
def detector_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Two detectors; the second finds JSON objects in values."""

    def json_objects(values: DataFrame) -> DataFrame:
        texts = [name for name, kind in values.dtypes if kind == "string"]
        shares = values.agg(*[F.avg(F.col(name).startswith("{").cast("double")).alias(name) for name in texts])
        long = shares.unpivot([], texts, "column", "confidence")
        return long.select(
            "column",
            F.when(F.col("confidence") > 0.5, "device_id").otherwise("none").alias("category"),
            F.when(F.col("confidence") > 0.5, F.col("confidence")).otherwise(0.0).alias("confidence"),
            F.lit("JSON stage.").alias("explanation"),
        )

    votes = aggregate_votes(_contacts(spark, folder), [PATTERN_DETECTOR, ("json", json_objects)], threshold=0.75)
    return rounded(
        votes.select(
            "column_name", "category", "confidence", "recommended_action",
            F.size("votes").cast("bigint").alias("vote_count"),
        )
    )


# -- correlation


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    return lineitem.select(
        *numeric_columns(lineitem),
        F.lit(0.1).alias("constant"),
        (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("twice_the_price"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount_or_null"),
    )


@query
def pearson(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_table(_measures(spark, folder))


@query
def high_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return high_correlations(_measures(spark, folder))


@query
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    columns = read_table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    return correlation_table(columns, "spearman")


@query
def spearman_nulls(spark: SparkSession, folder: str) -> DataFrame:
    columns = _measures(spark, folder).select("l_extendedprice", "discount_or_null")
    return correlation_table(columns, "spearman")


def _gapped(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Line item measures, each missing in rows of its own."""
    measures = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
    cells = [
        F.when((F.col("l_orderkey") + k * F.col("l_linenumber")) % (k + 3) != 0, F.col(measures[k % 5]) + k * F.col("l_tax"))
        for k in range(number)
    ]
    return read_table(spark, folder, "lineitem").select(*[cell.alias(f"g{k}") for k, cell in enumerate(cells)])


@query
def pearson_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_table(_gapped(spark, folder, 20))


@query
def spearman_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return correlation_table(_gapped(spark, folder, 5), "spearman")


@query
def correlation_limits(spark: SparkSession, folder: str) -> DataFrame:
    """What a correlation of one numeric column, of two, and by a method that isn't offered gives for each region."""
    region = read_table(spark, folder, "region").select("r_regionkey", "r_name")
    one = correlation_table(region).select(F.lit("one column").alias("case"), "col_a", "col_b", "corr")
    twice = region.withColumn("r_double", F.col("r_regionkey") * 2.0)
    two = correlation_table(twice).select(F.lit("two columns").alias("case"), "col_a", "col_b", "corr")
    try:
        refused = correlation_table(twice, "kendall")
    except FeatureSparkError:
        refused = twice.groupBy().agg(F.count("*").cast("double").alias("corr")).select(
            F.lit("r_regionkey").alias("col_a"), F.lit("kendall refused").alias("col_b"), "corr"
        )
    return one.unionByName(two).unionByName(refused.select(F.lit("kendall").alias("case"), "col_a", "col_b", "corr"))


# -- transformations


def _discounts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_discount", F.lit(0.0)).alias("discount")
    )


@query
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(transform(_discounts(spark, folder), "fill_missing", {"column": "discount"}))


@query
def fill_mean(spark: SparkSession, folder: str) -> DataFrame:
    params = {"column": "discount", "strategy": "mean"}
    return rounded(transform(_discounts(spark, folder), "fill_missing", params))


@query
def fill_mode(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return transform(orders, "fill_missing", {"column": "priority", "strategy": "mode"})


@query
def fill_constant(spark: SparkSession, folder: str) -> DataFrame:
    params = {"column": "discount", "strategy": "constant", "value": -1}
    return transform(_discounts(spark, folder), "fill_missing", params)


@query
def log_transform(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(transform(read_table(spark, folder, "customer"), "log_transform", {"column": "c_acctbal"}))


@query
def ratio(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    params = {"numerator": "l_extendedprice", "denominator": "l_discount"}
    return rounded(transform(lineitem, "ratio", params)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice_over_l_discount"
    )


@query
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(transform(read_table(spark, folder, "events"), "standard_scale", {"column": "value"})).select(
        "event_id", "value_scaled"
    )


@query
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return transform(orders, "one_hot_encode", {"column": "o_orderpriority"})


@query
def one_hot_many(spark: SparkSession, folder: str) -> DataFrame:
    """More values than a row may have columns: positions from a dictionary table."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _as_bigint(one_hot_positions(lines, "l_partkey"), "l_partkey_position")


@query
def one_hot_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Values that differ by case only get a column each."""
    key = F.col("o_orderkey") % 4
    answer = F.when(key == 0, "Yes").when(key == 1, "yes").when(key == 2, "YES").otherwise("no")
    orders = read_table(spark, folder, "orders").select("o_orderkey", answer.alias("answer"))
    return transform(orders, "one_hot_encode", {"column": "answer"})


@query
def one_hot_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse one-hot rows of a table whose columns have any names."""
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("_at"), F.col("l_quantity").alias("_hot"), F.col("l_suppkey").alias("_value")
    )
    vectors = one_hot_vectors(lines, "_value")
    vector = F.col("_value_vector")
    return vectors.select(
        "l_orderkey", "_at", "_hot", "_value", vector["size"].alias("vector_size"), F.get(vector["indices"], F.lit(0)).alias("vector_index"),
        F.get(vector["values"], F.lit(0)).alias("vector_value"),
    )


@query
def one_hot_numbers(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return transform(lines, "one_hot_encode", {"column": "l_linenumber"})


@query
def binning(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    binned = transform(transform(lines, "binning", {"column": "l_quantity"}),
                       "binning", {"column": "l_extendedprice", "bins": 12})
    return _as_bigint(binned, "l_quantity_bin", "l_extendedprice_bin")


@query
def binning_edges(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    binned = transform(lines, "binning", {"column": "l_quantity", "bins": [5, 10, 20, 20, 45]})
    return _as_bigint(binned, "l_quantity_bin")


def _as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})


@query
def date_features(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    dated = transform(orders, "date_features", {"column": "o_orderdate"})
    return _as_bigint(dated, *dated.columns[2:])


@query
def date_features_text(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "junk").otherwise(F.col("o_orderdate").cast("string"))
    orders = read_table(spark, folder, "orders").select("o_orderkey", text.alias("ordered"))
    dated = transform(orders, "date_features", {"column": "ordered"})
    return _as_bigint(dated, *dated.columns[2:])


@query
def date_features_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Text in another form than ISO, with some junk; the form is found."""
    text = F.when(F.col("o_orderkey") % 10 == 0, "junk").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    orders = read_table(spark, folder, "orders").select("o_orderkey", text.alias("ordered"))
    dated = transform(orders, "date_features", {"column": "ordered"})
    return _as_bigint(dated, *dated.columns[2:])


# -- versions and plans

PLAN = """```json
[
 {"name": "filled", "operation": "fill_missing", "source_columns": ["discount"], "rationale": "gaps",
  "params": {"column": "discount", "strategy": "median"}},
 {"name": "unit_price", "operation": "ratio", "source_columns": ["l_extendedprice", "l_quantity"],
  "rationale": "price per unit", "risk_level": "low",
  "params": {"numerator": "l_extendedprice", "denominator": "l_quantity", "new_column": "unit_price"}},
 {"name": "scaled", "operation": "standard_scale", "source_columns": ["unit_price"], "rationale": "comparable",
  "params": {"column": "unit_price"}},
 {"name": "wrong", "operation": "log_transform", "source_columns": ["l_returnflag"], "rationale": "fails",
  "params": {"column": "l_returnflag"}},
 {"name": "unknown", "operation": "no_such_operation", "source_columns": [], "rationale": "fails", "params": {}},
 {"name": "bins", "operation": "binning", "source_columns": ["discount"], "rationale": "groups",
  "params": {"column": "discount", "bins": 4}},
 {"name": "not_approved", "operation": "log_transform", "source_columns": ["l_tax"], "rationale": "left out",
  "params": {"column": "l_tax"}},
 {"operation": "ratio", "rationale": "an item without a name is dropped"}
]
```"""


def _plan_table(spark: SparkSession, folder: str) -> TableHandle:
    lines = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )
    return TableHandle(lines)


def _run(table: TableHandle, spark: SparkSession):
    proposals = parse_plan(spark.createDataFrame([(PLAN,)], "value string"))
    names = approved_names(proposals, "modify", ["filled", "unit_price", "scaled", "wrong", "unknown", "bins"])
    return run_plan(table, proposals, names)


@query
def plan_run(spark: SparkSession, folder: str) -> DataFrame:
    table = _plan_table(spark, folder)
    _run(table, spark)
    return _as_bigint(rounded(table.df, DIGITS + 1), "discount_bin")


@query
def plan_log(spark: SparkSession, folder: str) -> DataFrame:
    table = _plan_table(spark, folder)
    log = _run(table, spark).log_table(spark)
    rows = F.lit(table.metadata().first().row_count).cast("bigint").alias("row_count")
    return log.select(
        F.col("step").cast("bigint").alias("step"), "name", "status", "version_before", "version_after", rows
    )


@query
def plan_summary(spark: SparkSession, folder: str) -> DataFrame:
    table = _plan_table(spark, folder)
    text = run_summary(_run(table, spark))
    return table.metadata().select(F.lit(text).alias("summary"), "row_count", "column_count", "version")


@query
def plan_rollback(spark: SparkSession, folder: str) -> DataFrame:
    table = _plan_table(spark, folder)
    table.apply("log_transform", {"column": "l_tax"})
    table.apply("standard_scale", {"column": "l_quantity"})
    table.rollback(1)
    table.apply("binning", {"column": "l_quantity", "bins": 3})  # takes the place of version 2
    return _as_bigint(rounded(table.df), "l_quantity_bin")


@query
def guarded_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What a guarded table refuses, beside its versions and rows: a hidden column, a wrong strategy, unknown names."""
    customer = read_table(spark, folder, "customer").withColumn("mail", F.concat("c_name", F.lit("@example.com")))
    customer = customer.withColumn("mail", F.regexp_replace("mail", "#", "-"))
    table = TableHandle(customer, blocked_columns=["c_acctbal"])
    requests = (
        ("one_hot_encode", {"column": "mail"}), ("log_transform", {"column": "c_acctbal"}),
        ("fill_missing", {"column": "c_nationkey", "strategy": "guess"}), ("no_such_name", {}),
        ("standard_scale", {"column": "c_nationkey"}),
    )
    rows = []
    for step, (name, params) in enumerate(requests):
        try:
            table.apply(name, params)
            answer = "applied"
        except FeatureSparkError:
            answer = "refused"
        versions = len(table.list_versions())
        rows.append((step, name, answer, versions, name in list_transformations()))
    schema = "step bigint, name string, answer string, versions bigint, is_known boolean"
    counts = table.df.agg(F.count("*").alias("row_count"), F.round(F.stddev_samp("c_nationkey_scaled"), 6).alias("scaled_std"))
    found = counts.first()
    answers = spark.createDataFrame(rows, schema)
    return answers.withColumns({name: F.lit(found[name]).cast(counts.schema[name].dataType) for name in counts.columns})


@query
def version_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id", "value")
    table = TableHandle(events, snapshot_path=work_folder(spark))
    table.apply("log_transform", {"column": "value"})
    table.apply("standard_scale", {"column": "value_log"})
    return rounded(table.df)


@query
def version_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Versions kept as steps over one table, older ones removed, and the last one read back from its folder."""
    events = read_table(spark, folder, "events").select("event_id", "value")
    table = TableHandle(events, snapshot_path=work_folder(spark))
    table.apply("log_transform", {"column": "value"})
    table.apply("standard_scale", {"column": "value_log"})
    table.apply("binning", {"column": "value", "bins": 4})
    left = table.remove_versions([1])
    again = _as_bigint(rounded(read_version(spark, table.version_folder())), "value_bin")
    return again.withColumn("versions_left", F.lit(len(left)).cast("bigint"))


@query
def csv_source(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as CSV with some missing-value words, and read back with inferred types."""
    path = work_folder(spark)
    key = F.col("o_orderkey")
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, "NA").when(key % 7 == 1, "").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_totalprice") > 250000, "True").otherwise("False").alias("is_large"),
        F.concat(F.col("o_orderpriority"), F.lit(', "so"\nand so')).alias("priority"),
        F.col("o_orderdate").cast("string").alias("ordered"),
    )
    orders.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path)


@query
def stream_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Steps fitted on the table, applied to the same rows arriving as a stream."""
    events = read_table(spark, folder, "events")
    fitted = [
        get_transformation("standard_scale").fit(events, {"column": "value"}),
        get_transformation("binning").fit(events, {"column": "value", "bins": 6}),
    ]
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path = work_folder(spark)
    write_stream(transform_stream(stream, fitted), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    result = spark.read.parquet(f"{path}/rows").select("event_id", "value_scaled", "value_bin")
    return _as_bigint(rounded(result), "value_bin")


# -- texts and budgets


@query
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return documents.select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    urgency = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return read_table(spark, folder, "conversations").withColumn("urgency", urgency)


@query
def budget_turns(spark: SparkSession, folder: str) -> DataFrame:
    kept = budget_select(_turns(spark, folder), "conv_id", "turn", "text", "urgency", 320, 64)
    return kept.select("conv_id", "turn", "role", "text")


@query
def budget_null_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A seventh of the conversations without a group: null is a group like others."""
    turns = _turns(spark, folder).withColumn("grp", F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")))
    turns = turns.withColumn("place", F.col("conv_id") * 1000 + F.col("turn"))
    return budget_select(turns, "grp", "place", "text", None, 320, 64).select("grp", "place", "role")


@query
def budget_totals(spark: SparkSession, folder: str) -> DataFrame:
    return budget_summary(_turns(spark, folder), "conv_id", "turn", "text", None, 320, 64)


@query
def budget_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of very different sizes: documents per source within the default budget."""
    return budget_summary(read_table(spark, folder, "documents"), "source", "doc_id", "text")


@query
def profile_report(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    return profile_lines(profile_table(lineitem))


@query
def pair_report(spark: SparkSession, folder: str) -> DataFrame:
    return pair_lines(high_correlations(_measures(spark, folder), high_corr_threshold=0.5))
