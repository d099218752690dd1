"""Which columns look like personal data, judged by their names and by the form of their values."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.errors import DataAccessError
from featurespark.functions.columns import STRING, chunks, field_of, ref, type_class

# Categories with the name parts that hint at them, the first that fits is taken.
NAME_HINTS: dict[str, tuple[str, ...]] = {
    "email": ("email", "e_mail", "mail_address"),
    "phone": ("phone", "mobile", "contact_number", "tel"),
    "ssn": ("ssn", "social_security"),
    "aadhaar": ("aadhaar", "aadhar"),
    "pan": ("pan_number", "pan_no"),
    "passport": ("passport",),
    "credit_card": ("credit_card", "card_number", "ccn"),
    "name": ("first_name", "last_name", "full_name", "customer_name", "given_name", "surname"),
    "address": ("address", "street", "zipcode", "postal_code"),
    "ip_address": ("ip_address", "ip_addr"),
    "uuid": ("uuid", "guid"),
    "device_id": ("device_id", "imei", "mac_address"),
    "user_id": ("user_id", "customer_id", "account_id"),
    "session_id": ("session_id", "session_token"),
}

# The form of a value per category, in order of preference at equal match ratios.
# Digits and word characters are Unicode classes.
VALUE_PATTERNS: dict[str, str] = {
    "email": r"^[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?\p{Nd}{7,15}$",
    "ssn": r"^\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}$",
    "credit_card": r"^(\p{Nd}{4}[- ]?){3}\p{Nd}{1,4}$",
    "ip_address": r"^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "hash": r"^[a-fA-F0-9]{32,64}$",
}

# Shortest and longest text that a pattern can match; other values are not searched.
VALUE_LENGTHS: dict[str, tuple[int, int | None]] = {
    "email": (6, None),
    "phone": (7, 16),
    "ssn": (11, 11),
    "credit_card": (13, 19),
    "ip_address": (7, 15),
    "uuid": (36, 36),
    "hash": (32, 64),
}

# What is advised for a column of each category.
ACTIONS: dict[str, str] = {
    "email": "mask",
    "phone": "mask",
    "ssn": "remove",
    "aadhaar": "remove",
    "pan": "remove",
    "passport": "remove",
    "credit_card": "remove",
    "name": "mask",
    "address": "mask",
    "ip_address": "summarize_only",
    "uuid": "summarize_only",
    "hash": "summarize_only",
    "device_id": "summarize_only",
    "user_id": "summarize_only",
    "session_id": "summarize_only",
}

# Confidence of a name hint and of a value form, and the sentence that explains a vote.
NONE = "none"
NAME_CONFIDENCE = 0.7
VALUE_CONFIDENCE_LEAST, VALUE_CONFIDENCE_SPAN, VALUE_CONFIDENCE_MOST = 0.5, 0.45, 0.95
BASES = {"value": "value pattern match", "name": "column name heuristic", "none": "no signal"}
EXPLANATION = "Regex stage classified column '%s' as %s based on %s (confidence=%.2f)."

DEFAULT_THRESHOLD = 0.6
SAMPLE_SIZE = 20
COLUMNS_PER_JOB = 40

VOTE_TYPE = "struct<stage_name:string,category:string,confidence:double,explanation:string>"

# A detector looks at a table of values, one column of text per column of the data, and returns
# rows (column, category, confidence, explanation). The name identifies it in votes.
Detector = tuple[str, Callable[[DataFrame], DataFrame]]


def name_hints(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Rows (column, category, place): every category whose hints a column name holds, in the order of the hints."""
    hints = [(place, category, part) for place, (category, parts) in enumerate(NAME_HINTS.items()) for part in parts]
    listed = F.explode(F.array(*[F.struct(*map(F.lit, hint)).cast("struct<place:int,category:string,part:string>") for hint in hints]))
    columns = spark.createDataFrame([(name,) for name in names], "column string").select("column", listed.alias("hint"))
    held = columns.where(F.contains(F.lower("column"), F.col("hint.part")))
    return held.select("column", "hint.category", "hint.place").distinct()


# Characters that Python's strip() removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """Text without white space around it, tabs, line ends and Unicode spaces included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def can_match(field: T.StructField) -> bool:
    """Only text, whole numbers and decimals can have one of the value forms."""
    return type_class(field) == STRING or isinstance(field.dataType, (T.IntegralType, T.DecimalType))


def match_ratios(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Share of non-missing values that have each form: rows (column, category, matches, filled, ratio).

    One scan over all rows and whole values. The columns are stacked, so the seven patterns are
    compiled into one short loop, and each task sends one row per column.
    """
    names = [n for n in (df.columns if columns is None else columns) if can_match(field_of(df.schema, n))]
    schema = "column string, category string, matches bigint, filled bigint, ratio double"
    rows = []
    for part in chunks(names, COLUMNS_PER_JOB):
        texts = F.array(*[ref(name).cast("string") for name in part])
        long = df.select(F.posexplode(texts).alias("column", "text")).where(F.col("text").isNotNull())
        long = long.select("column", stripped(F.col("text")).alias("value"))
        long = long.select("column", "value", F.length("value").alias("length"))
        matches = []
        for category, pattern in VALUE_PATTERNS.items():
            shortest, longest = VALUE_LENGTHS[category]
            length = F.col("length")
            fits = length >= shortest if longest is None else length.between(shortest, longest)
            matches.append(F.count_if(fits & F.col("value").rlike(pattern)).alias(category))
        counts = long.groupBy("column").agg(F.count("*").alias("filled"), *matches)
        found = {row["column"]: row for row in counts.collect()}  # one row per column
        for index, name in enumerate(part):
            row = found.get(index)
            for category in VALUE_PATTERNS:
                hits, filled = (row[category], row["filled"]) if row else (0, 0)
                rows.append((name, category, hits, filled, hits / filled if filled else 0.0))
    return df.sparkSession.createDataFrame(rows, schema)


def pattern_votes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The built-in detector: of all candidates of a column the most confident one.

    Candidates are the value forms that occur, the name hint, and none. At equal confidence forms come first, in
    their stated order, and none comes last.
    """
    names = list(df.columns if columns is None else columns)
    spark = df.sparkSession
    order = F.array_position(F.array(*map(F.lit, VALUE_PATTERNS)), F.col("category"))
    sure = F.least(F.lit(VALUE_CONFIDENCE_MOST), F.lit(VALUE_CONFIDENCE_LEAST) + F.col("ratio") * VALUE_CONFIDENCE_SPAN)
    forms = match_ratios(df, names).where("ratio > 0").select(
        "column", F.col("ratio").alias("ratio"), sure.alias("confidence"), order.alias("place"), "category",
        F.lit(BASES["value"]).alias("basis"),
    )
    hints = name_hints(spark, names).select(
        "column", F.lit(0.0).alias("ratio"), F.lit(NAME_CONFIDENCE).alias("confidence"), (F.col("place") + 100).alias("place"),
        "category", F.lit(BASES["name"]).alias("basis"),
    )
    stated = [(name, 0.0, 0.0, 1_000, NONE, BASES["none"]) for name in names]
    schema = "column string, ratio double, confidence double, place long, category string, basis string"
    candidates = forms.unionByName(hints).unionByName(spark.createDataFrame(stated, schema))
    rank = F.struct(F.col("confidence"), F.col("ratio"), -F.col("place"))
    best = candidates.groupBy("column").agg(F.max_by(F.struct("category", "confidence", "basis"), rank).alias("vote"))
    votes = [(r["column"], *r["vote"]) for r in best.collect()]  # one row per column
    rows = [(name, kind, sure, EXPLANATION % (name, kind, basis, sure)) for name, kind, sure, basis in votes]
    return spark.createDataFrame(rows, "column string, category string, confidence double, explanation string")


PATTERN_DETECTOR: Detector = ("regex", pattern_votes)


def aggregate_votes(
    df: DataFrame, detectors: Sequence[Detector] = (PATTERN_DETECTOR,), threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """One row per column: the most confident vote, the earliest detector's among equals.

    A vote below the threshold makes the column not sensitive, but its confidence is kept.
    """
    if not detectors:
        raise DataAccessError("at least one detector is needed")
    votes = None
    for position, (stage, detect) in enumerate(detectors):
        part = detect(df).select(
            "column",
            F.lit(position).alias("position"),
            F.lit(stage).alias("stage_name"),
            "category",
            F.col("confidence").cast("double").alias("confidence"),
            "explanation",
        )
        votes = part if votes is None else votes.unionByName(part)
    vote = F.struct("position", "stage_name", "category", "confidence", "explanation")
    ordered = F.array_sort(F.collect_list(vote))
    # One vote per column and detector.
    grouped = votes.groupBy("column").agg(
        ordered.alias("ordered"),
        F.max_by("category", F.struct("confidence", -F.col("position"))).alias("best"),
        F.max("confidence").alias("confidence"),
    )
    category = F.when(F.col("confidence") < threshold, NONE).otherwise(F.col("best"))
    advised = F.create_map(*[F.lit(item) for pair in ACTIONS.items() for item in pair])
    action = F.when(F.col("confidence") < threshold, "allow").otherwise(
        F.coalesce(F.try_element_at(advised, F.col("category")), F.lit("summarize_only"))
    )
    names = F.array(*[F.lit(name) for name in df.columns])
    # One row per column of the data: few enough for one sorted partition.
    return (
        grouped.withColumn("place", F.array_position(names, F.col("column")))
        .where(F.col("place") > 0)
        .withColumn("category", category)
        .select(
            "place",
            F.col("column").alias("column_name"),
            "category",
            "confidence",
            (F.col("category") != NONE).alias("is_sensitive"),
            action.alias("recommended_action"),
            F.array_join(F.col("ordered.explanation"), " | ").alias("explanation"),
            F.transform("ordered", lambda v: v.dropFields("position")).cast(f"array<{VOTE_TYPE}>").alias("votes"),
        )
        .coalesce(1)
        .sortWithinPartitions("place")
        .drop("place")
    )
