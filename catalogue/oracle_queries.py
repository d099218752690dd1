"""SQL for DuckDB with the same results as the registered queries, over the same whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Fixed values, stated here on their own so that a wrong one in the package does not go unnoticed.
NAME_HINTS = {
    "email": "email|e_mail|mail_address",
    "phone": "phone|mobile|contact_number|tel",
    "ssn": "ssn|social_security",
    "aadhaar": "aadhaar|aadhar",
    "pan": "pan_number|pan_no",
    "passport": "passport",
    "credit_card": "credit_card|card_number|ccn",
    "name": "first_name|last_name|full_name|customer_name|given_name|surname",
    "address": "address|street|zipcode|postal_code",
    "ip_address": "ip_address|ip_addr",
    "uuid": "uuid|guid",
    "device_id": "device_id|imei|mac_address",
    "user_id": "user_id|customer_id|account_id",
    "session_id": "session_id|session_token",
}
VALUE_PATTERNS = {
    "email": r"^[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?\p{Nd}{7,15}$",
    "ssn": r"^\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}$",
    "credit_card": r"^(\p{Nd}{4}[- ]?){3}\p{Nd}{1,4}$",
    "ip_address": r"^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "hash": r"^[a-fA-F0-9]{32,64}$",
}
ACTIONS = {
    "remove": ("ssn", "aadhaar", "pan", "passport", "credit_card"),
    "mask": ("email", "phone", "name", "address"),
    "summarize_only": ("ip_address", "uuid", "hash", "device_id", "user_id", "session_id"),
}

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# -- profiles


def counts(column: str) -> str:
    return f"""count(*) - count({column}) AS null_count,
  round(100.0 * (count(*) - count({column})) / count(*), 4) AS null_percentage,
  count(DISTINCT {column}) AS unique_count,
  round(count(DISTINCT {column})::DOUBLE / count(*), 6) AS cardinality_ratio,
  count(DISTINCT {column}) <= 1 AS is_constant"""


def numeric_profile(source: str, column: str, dtype: str) -> str:
    value = f"{column}::DOUBLE"
    same = f"min({column}) = max({column})"
    return f"""SELECT '{column}' AS name, '{dtype}' AS dtype, {counts(column)},
  round(avg({value}), 7) AS mean, round(quantile_cont({value}, 0.5), 7) AS median,
  round(stddev_samp({value}), 7) AS std, min({value}) AS min, max({value}) AS max,
  CASE WHEN {same} THEN 0.0::DOUBLE ELSE round(skewness({value}), 7) END AS skewness,
  CASE WHEN {same} THEN 0.0::DOUBLE ELSE round(kurtosis({value}), 7) END AS kurtosis,
  round(quantile_cont({value}, 0.25), 7) AS p25, round(quantile_cont({value}, 0.5), 7) AS p50,
  round(quantile_cont({value}, 0.75), 7) AS p75
FROM {source}"""


def mode_of(source: str, column: str, text: str | None = None) -> str:
    shown = text or f"{column}::VARCHAR"
    return f"""(SELECT {shown} FROM {source} WHERE {column} IS NOT NULL
   GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


def categorical_profile(source: str, column: str, dtype: str, text: str | None = None) -> str:
    return f"SELECT '{column}' AS name, '{dtype}' AS dtype, {counts(column)}, {mode_of(source, column, text)} AS mode FROM {source}"


ORACLES["profile_numeric"] = union(
    [numeric_profile("lineitem", c, "integer") for c in LINE_NUMBERS]
    + [numeric_profile("lineitem", c, "float") for c in LINE_MEASURES]
)

ORACLES["profile_numeric_nulls"] = """WITH t AS (
  SELECT nullif(l_discount, 0) AS discount_or_null,
         CASE WHEN l_linenumber <> 1 THEN l_tax END AS tax_or_nan, 2.5::DOUBLE AS always_the_same FROM lineitem)
""" + union([numeric_profile("t", c, "float") for c in ("discount_or_null", "tax_or_nan", "always_the_same")])

BOOLEAN_TEXT = "CASE WHEN {0} THEN 'True' ELSE 'False' END"

ORACLES["profile_categorical"] = """WITH o AS (
  SELECT *, nullif(o_orderpriority, '5-LOW') AS priority_or_null, o_totalprice > 250000 AS is_large FROM orders)
""" + union(
    [
        categorical_profile("o", "o_orderpriority", "string"),
        categorical_profile("o", "o_orderstatus", "string"),
        categorical_profile("o", "o_orderdate", "datetime"),
        categorical_profile("o", "priority_or_null", "string"),
        categorical_profile("o", "is_large", "boolean", BOOLEAN_TEXT.format("is_large")),
        categorical_profile("customer", "c_mktsegment", "string"),
        categorical_profile("customer", "c_name", "string"),
    ]
)


ORACLES["profile_texts"] = "WITH turns AS (SELECT role, text AS said FROM conversations)\n" + union(
    [categorical_profile("documents", c, "string") for c in ("text", "lang", "source")]
    + [categorical_profile("pages", c, "string") for c in ("url", "html")]
    + [categorical_profile("turns", c, "string") for c in ("role", "said")]
)


def histogram(column: str) -> str:
    return f"""SELECT '{column}' AS name, bin, round(low, 6) AS low_edge, round(high, 6) AS high_edge,
  (SELECT count(*) FROM lineitem WHERE {column}::DOUBLE > low AND {column}::DOUBLE <= high) AS row_count
FROM (
  SELECT i AS bin, CASE WHEN i = 0 THEN mn - (mx - mn) * 0.001 ELSE mn + i::DOUBLE * ((mx - mn) / 10) END AS low,
    CASE WHEN i = 9 THEN mx ELSE mn + (i + 1)::DOUBLE * ((mx - mn) / 10) END AS high
  FROM (SELECT min({column})::DOUBLE AS mn, max({column})::DOUBLE AS mx FROM lineitem) AS b, range(10) AS r(i)) AS e"""


ORACLES["histogram"] = union(
    [histogram(c) for c in ("l_discount", "l_quantity", "l_extendedprice", "l_linenumber")]
)


def duplicates(source: str, groups: list[list[str]]) -> str:
    parts = []
    for group in groups:
        for column in group:
            cases = " ".join(
                f"WHEN bool_and({column} IS NOT DISTINCT FROM {other}) THEN '{other}'"
                for other in group
                if other != column
            )
            found = f"CASE {cases} END" if cases else "max(NULL::VARCHAR)"
            parts.append(f"SELECT '{column}' AS name, {found} AS is_duplicate_of FROM {source}")
    return union(parts)


ORACLES["duplicate_columns"] = """WITH o AS (
  SELECT *, o_orderkey AS o_orderkey_copy, o_orderstatus AS o_status_copy,
    CASE WHEN o_orderkey = 7 THEN 8 ELSE o_orderkey END AS o_almost FROM orders)
""" + duplicates(
    "o",
    [
        ["o_orderkey", "o_custkey", "o_orderkey_copy", "o_almost"],
        ["o_orderstatus", "o_orderpriority", "o_status_copy"],
        ["o_totalprice"],
        ["o_orderdate"],
    ],
)

ORACLES["table_metadata"] = """SELECT 'spark' AS engine, count(*) AS row_count, 6::BIGINT AS column_count,
  (32 * count(*) + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)))::BIGINT AS size_bytes,
  0::BIGINT AS version FROM orders"""


def schema_row(source: str, column: str, dtype: str, is_pii: bool, is_blocked: bool) -> str:
    return f"""SELECT '{column}' AS name, '{dtype}' AS dtype, count(*) > count({column}) AS nullable,
  {is_pii} AS is_pii, {is_blocked} AS is_blocked FROM {source}"""


ORACLES["table_schema"] = """WITH e AS (SELECT *, nullif(value > 50, false) AS large FROM events)
""" + union(
    [
        schema_row("e", "event_id", "integer", False, False),
        schema_row("e", "ts", "datetime", False, False),
        schema_row("e", "user_id", "integer", True, False),
        schema_row("e", "event_type", "string", False, False),
        schema_row("e", "value", "float", False, False),
        schema_row("e", "props", "string", False, True),
        schema_row("e", "large", "boolean", False, False),
    ]
)


ORACLES["single_profile"] = """SELECT 'value' AS name, 'float' AS dtype, count(*) - count(value) AS null_count,
  count(DISTINCT value) AS unique_count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(stddev_samp(value), 6) AS std FROM events"""


def visible_row(column: str, dtype: str) -> str:
    numeric = dtype in ("integer", "float")
    mode = "NULL::VARCHAR" if numeric else mode_of("events", column)
    number = [f"round({f}({column}::DOUBLE), 6)" if numeric else "NULL::DOUBLE" for f in ("avg", "min", "max")]
    return f"""SELECT '{column}' AS name, '{dtype}' AS dtype, count(*) - count({column}) AS null_count,
  count(DISTINCT {column}) AS unique_count, {mode} AS mode, {number[0]} AS mean, {number[1]} AS min, {number[2]} AS max
FROM events"""


VISIBLE_EVENTS = {
    "event_id": "integer",
    "ts": "datetime",
    "event_type": "string",
    "value": "float",
    "props": "string",
}
ORACLES["visible_profile"] = union([visible_row(*item) for item in VISIBLE_EVENTS.items()])


def analyzed_row(column: str, dtype: str, is_pii: bool) -> str:
    unique = "NULL::BIGINT" if is_pii else f"count(DISTINCT {column})"
    mean = f"round(avg({column}), 6)" if dtype in ("integer", "float") and not is_pii else "NULL::DOUBLE"
    return f"""SELECT '{column}' AS name, '{dtype}' AS dtype, count(*) > count({column}) AS nullable, {is_pii} AS is_pii,
  {unique} AS unique_count, {mean} AS mean, count(*) AS row_count, 0::BIGINT AS version FROM events"""


ORACLES["analyze_events"] = union(
    [analyzed_row(name, dtype, False) for name, dtype in VISIBLE_EVENTS.items()]
    + [analyzed_row("user_id", "integer", True)]
)

# -- projections and samples

ORACLES["numeric_projection"] = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"
ORACLES["null_filter"] = """SELECT l_orderkey, l_linenumber, l_discount AS discount FROM lineitem
WHERE l_linenumber <> 1 AND l_discount <> 0"""
ORACLES["visible_projection"] = "SELECT event_id, ts, event_type, value FROM events"
ORACLES["capped_preview"] = """SELECT event_id::VARCHAR AS event_id, ts::VARCHAR AS ts, event_type,
  value::VARCHAR AS value, CASE WHEN value > 10 THEN 'True' ELSE '' END AS high
FROM events ORDER BY events.event_id LIMIT 5"""


def first_values(column: str, text: str) -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column", {text} AS value FROM events
  WHERE {text} IS NOT NULL ORDER BY event_id LIMIT 20) AS s_{column}"""


ORACLES["value_sample"] = union(
    [
        first_values("event_id", "event_id::VARCHAR"),
        first_values("event_type", "event_type"),
        first_values("value_or_null", "CASE WHEN value > 20 THEN value::VARCHAR END"),
    ]
)

# -- sensitive columns

CONTACTS = """SELECT event_id, user_id, event_type, value, props,
  ' user' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE '@example.com' END || chr(9) AS contact,
  '+49' || lpad(event_id::VARCHAR, 9, '0') AS reachable,
  substr(lpad(event_id::VARCHAR, 9, '0'), 1, 3) || '-' || substr(lpad(event_id::VARCHAR, 9, '0'), 4, 2) || '-' ||
    CASE WHEN event_id % 2 = 0 THEN substr(lpad(event_id::VARCHAR, 9, '0'), 6, 4) ELSE 'x' END AS number,
  '10.0.' || (user_id % 256) || '.' || (event_id % 256) AS source,
  md5(event_id::VARCHAR) AS digest,
  '4000 1234 5678 ' || substr(lpad(event_id::VARCHAR, 9, '0'), 6, 4) AS paid_with
FROM events"""
CONTACT_TEXTS = ["event_type", "props", "contact", "reachable", "number", "source", "digest", "paid_with"]
CONTACT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props", *CONTACT_TEXTS[2:]]


def hint_case(name: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({name}), '{parts}') THEN '{kind}'" for kind, parts in NAME_HINTS.items())
    return f"CASE {cases} ELSE 'none' END"


def ratios(source: str, columns: list[str]) -> str:
    return union(
        [
            f"""SELECT '{column}' AS "column", '{category}' AS category,
  count(*) FILTER (WHERE regexp_matches(regexp_replace({column}::VARCHAR, '^\\s+|\\s+$', '', 'g'), '{pattern}')) AS matches,
  count({column}) AS filled,
  count(*) FILTER (WHERE regexp_matches(regexp_replace({column}::VARCHAR, '^\\s+|\\s+$', '', 'g'), '{pattern}'))::DOUBLE
    / count({column}) AS ratio FROM {source}"""
            for column in columns
            for category, pattern in VALUE_PATTERNS.items()
        ]
    )


def rounded_ratios(source: str, columns: list[str]) -> str:
    return f"""SELECT "column", category, matches, filled, round(ratio, 6) AS ratio FROM ({ratios(source, columns)}) AS r"""


ORACLES["value_ratio"] = f"WITH contacts AS ({CONTACTS})\n" + rounded_ratios(
    "contacts", ["event_id", "user_id", *CONTACT_TEXTS]
)
ORACLES["value_ratio_texts"] = rounded_ratios("documents", ["text", "lang", "source"])


def assessed(source: str) -> str:
    """CTEs that end in ``votes(column_name, category, confidence, explanation)`` of the value and name detector."""
    names = ", ".join(f"('{column}')" for column in CONTACT_COLUMNS)
    order = " ".join(f"WHEN '{category}' THEN {index}" for index, category in enumerate(VALUE_PATTERNS))
    return f"""contacts AS ({source}),
ratios AS ({ratios("contacts", [c for c in CONTACT_COLUMNS if c != "value"])}),
best AS (SELECT "column", category, ratio, least(0.95, 0.5 + ratio * 0.45) AS confidence,
  row_number() OVER (PARTITION BY "column" ORDER BY ratio DESC, CASE category {order} END) AS place FROM ratios),
named AS (SELECT n AS column_name, {hint_case('n')} AS hint FROM (VALUES {names}) AS v(n)),
joined AS (SELECT column_name, hint, CASE WHEN ratio > 0 THEN category ELSE 'none' END AS form,
  CASE WHEN ratio > 0 THEN confidence ELSE 0.0 END AS sure, CASE WHEN hint <> 'none' THEN 0.7 ELSE 0.0 END AS hinted
  FROM named LEFT JOIN best ON column_name = "column" AND place = 1),
votes AS (SELECT column_name,
  CASE WHEN form <> 'none' AND sure >= hinted THEN form ELSE hint END AS category,
  (CASE WHEN form <> 'none' AND sure >= hinted THEN sure ELSE hinted END)::DOUBLE AS confidence,
  CASE WHEN form <> 'none' AND sure >= hinted THEN 'value pattern match'
    WHEN hint <> 'none' THEN 'column name heuristic' ELSE 'no signal' END AS basis FROM joined)"""


ADVICE = "CASE " + " ".join(
    f"WHEN {{0}} IN {kinds} THEN '{action}'" for action, kinds in ACTIONS.items()
) + " ELSE 'summarize_only' END"

ORACLES["sensitive_columns"] = f"""WITH {assessed(CONTACTS)}
SELECT column_name, CASE WHEN confidence < 0.6 THEN 'none' ELSE category END AS category,
  round(confidence, 6) AS confidence, confidence >= 0.6 AND category <> 'none' AS is_sensitive,
  CASE WHEN confidence < 0.6 THEN 'allow' ELSE {ADVICE.format('category')} END AS recommended_action,
  'Regex stage classified column ''' || column_name || ''' as ' || category || ' based on ' || basis ||
    ' (confidence=' || printf('%.2f', confidence) || ').' AS explanation
FROM votes"""

ORACLES["sensitive_by_sample"] = f"""WITH {assessed(CONTACTS + " ORDER BY event_id LIMIT 20")}
SELECT column_name, CASE WHEN confidence < 0.6 THEN 'none' ELSE category END AS category,
  round(confidence, 6) AS confidence, confidence >= 0.6 AND category <> 'none' AS is_sensitive
FROM votes"""

JSON_SHARES = union(
    [f"SELECT '{column}' AS c, avg(starts_with({column}, '{{')::INT) AS share FROM contacts" for column in CONTACT_TEXTS]
)
ORACLES["detector_votes"] = f"""WITH {assessed(CONTACTS)},
json AS ({JSON_SHARES}),
combined AS (SELECT column_name,
  CASE WHEN coalesce(share, 0) > 0.5 AND share > confidence THEN 'device_id' ELSE category END AS category,
  CASE WHEN coalesce(share, 0) > 0.5 AND share > confidence THEN share ELSE confidence END AS confidence,
  1 + (share IS NOT NULL)::BIGINT AS vote_count FROM votes LEFT JOIN json ON column_name = c)
SELECT column_name, CASE WHEN confidence < 0.75 THEN 'none' ELSE category END AS category,
  round(confidence, 6) AS confidence,
  CASE WHEN confidence < 0.75 THEN 'allow' ELSE {ADVICE.format('category')} END AS recommended_action,
  vote_count::BIGINT AS vote_count
FROM combined"""

# -- correlation

MEASURES = """m AS (SELECT *, 0.1::DOUBLE AS constant, l_extendedprice * 2 + l_quantity AS twice_the_price,
  nullif(l_discount, 0) AS discount_or_null FROM lineitem)"""
MEASURE_COLUMNS = [*LINE_NUMBERS, *LINE_MEASURES, "constant", "twice_the_price", "discount_or_null"]


def correlation(source: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) THEN 0.0::DOUBLE
  ELSE round(corr({a}::DOUBLE, {b}::DOUBLE), 6) END AS corr FROM {source}"""


ORACLES["pearson"] = f"WITH {MEASURES}\n" + union(
    [correlation("m", a, b) for a in MEASURE_COLUMNS for b in MEASURE_COLUMNS]
)
UPPER = union(
    [
        correlation("m", a, b)
        for index, a in enumerate(MEASURE_COLUMNS)
        for b in MEASURE_COLUMNS[index + 1 :]
    ]
)
ORACLES["high_pairs"] = f"WITH {MEASURES}\nSELECT * FROM ({UPPER}) AS p WHERE abs(corr) >= 0.85"


def ranked(source: str, columns: list[str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in columns
    )
    return f"r AS (SELECT {ranks} FROM {source})"


SPEARMAN = ["l_quantity", "l_extendedprice", "l_tax"]
ORACLES["spearman"] = f"WITH {ranked('lineitem', SPEARMAN)}\n" + union(
    [correlation("r", a, b) for a in SPEARMAN for b in SPEARMAN]
)
GAPPED = ["l_extendedprice", "discount_or_null"]
ORACLES["spearman_nulls"] = (
    f"WITH {MEASURES}, c AS (SELECT * FROM m WHERE discount_or_null IS NOT NULL), {ranked('c', GAPPED)}\n"
    + union([correlation("r", a, b) for a in GAPPED for b in GAPPED])
)



def gapped(number: int) -> str:
    measures = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
    cells = [
        f"CASE WHEN (l_orderkey + {k} * l_linenumber) % {k + 3} <> 0 THEN ({measures[k % 5]} + {k} * l_tax)::DOUBLE END AS g{k}"
        for k in range(number)
    ]
    return f"g AS (SELECT {', '.join(cells)} FROM lineitem)"


ORACLES["pearson_gaps"] = f"WITH {gapped(20)}\n" + union(
    [correlation("g", f"g{a}", f"g{b}") for a in range(20) for b in range(20)]
)


def rank_pair(a: str, b: str) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {n}" for c, n in ((a, "x"), (b, "y"))
    )
    both = f"(SELECT {ranks} FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(x, y), 6) AS corr FROM {both} AS p"


ORACLES["spearman_gaps"] = f"WITH {gapped(5)}\n" + union([rank_pair(f"g{a}", f"g{b}") for a in range(5) for b in range(5)])
ORACLES["correlation_limits"] = """
SELECT 'two columns' AS "case", a AS col_a, b AS col_b, 1.0::DOUBLE AS corr
FROM (VALUES ('r_regionkey'), ('r_double')) AS x(a), (VALUES ('r_regionkey'), ('r_double')) AS y(b)
UNION ALL SELECT 'kendall', 'r_regionkey', 'kendall refused', count(*)::DOUBLE FROM region"""

# -- transformations

DISCOUNTS = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS discount FROM lineitem"


def filled(statistic: str) -> str:
    return f"""WITH d AS ({DISCOUNTS})
SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(discount, {statistic}), 6) AS discount FROM d"""


ORACLES["fill_median"] = filled("(SELECT quantile_cont(discount, 0.5) FROM d)")
ORACLES["fill_mean"] = filled("(SELECT avg(discount) FROM d)")
ORACLES["fill_constant"] = filled("-1")
ORACLES["fill_mode"] = f"""WITH p AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
SELECT o_orderkey, coalesce(priority, {mode_of('p', 'priority')}) AS priority FROM p"""
ORACLES["log_transform"] = "SELECT *, round(ln(1 + greatest(c_acctbal, 0)), 6) AS c_acctbal_log FROM customer"
ORACLES["ratio"] = """SELECT l_orderkey, l_linenumber, l_partkey,
  round(l_extendedprice / nullif(l_discount, 0), 6) AS l_extendedprice_over_l_discount FROM lineitem"""
ORACLES["standard_scale"] = """SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6)
  AS value_scaled FROM events"""


def flags(column: str, values: list[str]) -> str:
    return ", ".join(f"{column}::VARCHAR = '{value}' AS \"{column}_{value}\"" for value in values)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ORACLES["one_hot"] = f"SELECT o_orderkey, o_orderpriority, {flags('o_orderpriority', PRIORITIES)} FROM orders"
ORACLES["one_hot_numbers"] = f"""SELECT l_orderkey, l_partkey, l_linenumber,
  {flags('l_linenumber', [str(number) for number in range(1, 8)])} FROM lineitem"""


def equal_width(column: str, bins: int) -> str:
    """Number of inner edges below the value; needs ``mn`` and ``mx`` of the column in scope."""
    edges = [f"({column} > mn + {i}.0::DOUBLE * ((mx - mn) / {bins}))::BIGINT" for i in range(1, bins)]
    return " + ".join(edges)


def bounds(source: str, column: str, alias: str) -> str:
    return f"(SELECT min({column})::DOUBLE AS mn, max({column})::DOUBLE AS mx FROM {source}) AS {alias}"


ORACLES["binning"] = f"""WITH q AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, {equal_width('l_quantity', 5)} AS l_quantity_bin
  FROM lineitem, {bounds('lineitem', 'l_quantity', 'b')})
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_quantity_bin,
  {equal_width('l_extendedprice', 12)} AS l_extendedprice_bin
FROM q, {bounds('lineitem', 'l_extendedprice', 'b')}"""
ORACLES["binning_edges"] = """SELECT l_orderkey, l_partkey, l_quantity, (CASE
  WHEN l_quantity > 5 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 20 THEN 1
  WHEN l_quantity > 20 AND l_quantity <= 45 THEN 2 END)::BIGINT AS l_quantity_bin FROM lineitem"""


def date_parts(moment: str, name: str) -> str:
    return f"""year({moment})::BIGINT AS {name}_year, month({moment})::BIGINT AS {name}_month,
  (isodow({moment}) - 1)::BIGINT AS {name}_dayofweek"""


ORACLES["date_features"] = f"SELECT o_orderkey, o_orderdate, {date_parts('o_orderdate', 'o_orderdate')} FROM orders"
ORACLES["date_features_text"] = f"""WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'junk' ELSE o_orderdate::VARCHAR END AS ordered FROM orders)
SELECT o_orderkey, ordered, {date_parts('try_cast(ordered AS TIMESTAMP)', 'ordered')} FROM t"""

# -- versions and plans

ORACLES["plan_run"] = f"""WITH t AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_tax, l_returnflag, nullif(l_discount, 0) AS gaps FROM lineitem),
f AS (SELECT * EXCLUDE (gaps), coalesce(gaps, (SELECT quantile_cont(gaps, 0.5) FROM t)) AS discount,
  l_extendedprice / l_quantity AS unit FROM t)
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_tax, l_returnflag, round(discount, 7) AS discount,
  round(unit, 7) AS unit_price,
  round((unit - avg(unit) OVER ()) / stddev_samp(unit) OVER (), 7) AS unit_price_scaled,
  {equal_width('discount', 4)} AS discount_bin
FROM f, {bounds('f', 'discount', 'b')}"""
ORACLES["plan_log"] = """SELECT v.*, (SELECT count(*) FROM lineitem) AS row_count FROM (VALUES
  (0::BIGINT, 'filled', 'executed', 0::BIGINT, 1::BIGINT), (1, 'unit_price', 'executed', 1, 2),
  (2, 'scaled', 'executed', 2, 3), (3, 'wrong', 'failed', 3, 3), (4, 'unknown', 'failed', 3, 3),
  (5, 'bins', 'executed', 3, 4)) AS v(step, name, status, version_before, version_after)"""
ORACLES["plan_summary"] = """SELECT 'Executed 4 feature(s): filled, unit_price, scaled, bins. ' ||
  'Dataset moved from version 0 to 4.' AS summary,
  count(*) AS row_count, 10::BIGINT AS column_count, 4::BIGINT AS version FROM lineitem"""
ORACLES["plan_rollback"] = f"""WITH t AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_tax, l_returnflag, nullif(l_discount, 0) AS discount
  FROM lineitem)
SELECT t.*, round(ln(1 + l_tax), 6) AS l_tax_log, {equal_width('l_quantity', 3)} AS l_quantity_bin
FROM t, {bounds('t', 'l_quantity', 'b')}"""
ORACLES["version_snapshot"] = """WITH v AS (SELECT event_id, value, ln(1 + greatest(value, 0)) AS logged FROM events)
SELECT event_id, value, round(logged, 6) AS value_log,
  round((logged - avg(logged) OVER ()) / stddev_samp(logged) OVER (), 6) AS value_log_scaled FROM v"""
ORACLES["version_steps"] = f"""WITH v AS (SELECT event_id, value, ln(1 + greatest(value, 0)) AS logged FROM events)
SELECT event_id, value, round(logged, 6) AS value_log,
  round((logged - avg(logged) OVER ()) / stddev_samp(logged) OVER (), 6) AS value_log_scaled,
  {equal_width('value', 4)} AS value_bin, 2::BIGINT AS versions_left FROM v, {bounds('events', 'value', 'b')}"""
ORACLES["csv_source"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN o_custkey END AS customer,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_totalprice > 250000 AS is_large,
  o_orderpriority || ', "so"' || chr(10) || 'and so' AS priority, o_orderdate::VARCHAR AS ordered FROM orders"""
ORACLES["stream_apply"] = f"""SELECT event_id,
  round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS value_scaled,
  {equal_width('value', 6)} AS value_bin FROM events, {bounds('events', 'value', 'b')}"""

# -- texts and budgets

ORACLES["token_estimates"] = "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents"


def walk(source: str, group: str, position: str, urgency: str, budget: int) -> str:
    """Recursive CTE: one row per text in order, with the tokens used so far and whether the text was taken."""
    return f"""RECURSIVE ordered AS (
  SELECT {group} AS g, {position} AS p, greatest(1, length(text) // 4) AS cost,
    row_number() OVER (PARTITION BY {group} ORDER BY {urgency}, {position}) AS n FROM {source}),
walk AS (
  SELECT g, NULL::BIGINT AS p, 0::BIGINT AS n, 0::BIGINT AS used, true AS taken, 0::BIGINT AS cost
  FROM (SELECT DISTINCT g FROM ordered) AS d
  UNION ALL
  SELECT o.g, o.p, o.n, CASE WHEN w.used + o.cost <= {budget} THEN w.used + o.cost ELSE w.used END,
    w.used + o.cost <= {budget}, o.cost FROM walk AS w JOIN ordered AS o ON o.g = w.g AND o.n = w.n + 1)"""


URGENCY = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"
ORACLES["budget_turns"] = f"""WITH {walk('conversations', 'conv_id', 'turn', URGENCY, 256)}
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations AS c JOIN walk ON g = conv_id AND p = turn WHERE taken"""


def totals(group: str) -> str:
    return f"""SELECT g AS {group}, count(*) FILTER (WHERE taken AND n > 0) AS kept_rows, max(used) AS estimated_tokens,
  bool_or(NOT taken) AS truncated FROM walk GROUP BY g"""


ORACLES["budget_totals"] = f"WITH {walk('conversations', 'conv_id', 'turn', '0', 256)}\n" + totals("conv_id")
ORACLES["budget_documents"] = f"WITH {walk('documents', 'source', 'doc_id', '0', 6976)}\n" + totals("source")


def report_line(column: str, dtype: str) -> str:
    mean = f"avg({column})::VARCHAR" if dtype in ("integer", "float") else "'None'"
    return f"""SELECT '{column}' AS name, '{column}: dtype={dtype}, nulls=' ||
  round(100.0 * (count(*) - count({column})) / count(*), 4)::VARCHAR || '%, unique=' || count(DISTINCT {column}) ||
  ', mean=' || {mean} AS line FROM lineitem"""


ORACLES["profile_report"] = union(
    [report_line(c, "integer") for c in LINE_NUMBERS]
    + [report_line("l_quantity", "float")]
    + [report_line(c, "string") for c in ("l_returnflag", "l_linestatus")]
)
ORACLES["pair_report"] = f"""WITH {MEASURES}
SELECT col_a, col_b, col_a || '~' || col_b || '=' || printf('%.2f', corr) AS line FROM ({UPPER}) AS p
WHERE abs(corr) >= 0.5"""

# -- hard rows

ORACLES["profile_infinite"] = """WITH t AS (SELECT CASE l_linenumber WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE
  ELSE l_tax END AS value FROM lineitem)
SELECT 'value' AS name, 0::BIGINT AS null_count, count(DISTINCT value) AS unique_count, min(value) AS min,
  max(value) AS max, quantile_cont(value, 0.5) AS median, 0::BIGINT AS bins FROM t"""
ORACLES["profile_offset"] = """SELECT 'value' AS name, round(stddev_samp(l_quantity), 4) AS std,
  round(skewness(l_quantity), 4) AS skewness, round(kurtosis(l_quantity), 4) AS kurtosis,
  min(l_quantity) + 1e15 AS min, max(l_quantity) + 1e15 AS max FROM lineitem"""
ORACLES["late_sensitive"] = """WITH t AS (SELECT count(*) FILTER (WHERE o_orderkey > 1000) AS hits, count(*) AS n FROM orders)
SELECT 'note' AS name, least(0.95, 0.5 + 0.45 * hits / n) >= 0.6 AND hits > 0 AS is_pii, hits AS matches,
  round(hits::DOUBLE / n, 6) AS ratio FROM t
UNION ALL SELECT 'o_orderstatus', false, 0, 0.0"""
ORACLES["one_hot_many"] = """SELECT l_orderkey, l_linenumber, l_partkey,
  dense_rank() OVER (ORDER BY l_partkey) - 1 AS l_partkey_position FROM lineitem"""
ORACLES["one_hot_cases"] = """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'YES'
  ELSE 'no' END AS answer FROM orders)
SELECT *, answer = 'YES' AS "answer_^Y^E^S", answer = 'Yes' AS "answer_^Yes", answer = 'no' AS answer_no,
  answer = 'yes' AS answer_yes FROM o"""
ORACLES["one_hot_names"] = """SELECT l_orderkey, l_linenumber AS _at, l_quantity AS _hot, l_suppkey AS _value,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS vector_size, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS vector_index,
  1.0::DOUBLE AS vector_value FROM lineitem"""
ORACLES["date_features_formats"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 0 THEN 'junk' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS ordered,
  CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate) END AS ordered_year,
  CASE WHEN o_orderkey % 10 <> 0 THEN month(o_orderdate) END AS ordered_month,
  CASE WHEN o_orderkey % 10 <> 0 THEN isodow(o_orderdate) - 1 END AS ordered_dayofweek FROM orders"""
NULL_GROUPS = """(SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id ELSE -1 END AS grp, conv_id * 1000 + turn AS place, text, role
  FROM conversations)"""
ORACLES["budget_null_groups"] = f"""WITH {walk(NULL_GROUPS, 'grp', 'place', '0', 256)}
SELECT nullif(c.grp, -1) AS grp, c.place, c.role FROM {NULL_GROUPS} AS c JOIN walk ON g = grp AND p = place WHERE taken"""
ORACLES["guarded_requests"] = """SELECT v.*, n AS row_count, 1.0::DOUBLE AS scaled_std
FROM (VALUES (0::BIGINT, 'one_hot_encode', 'refused', 1::BIGINT, true), (1, 'log_transform', 'refused', 1, true),
  (2, 'fill_missing', 'refused', 1, true), (3, 'no_such_name', 'refused', 1, false),
  (4, 'standard_scale', 'applied', 2, true)) AS v(step, name, answer, versions, is_known),
  (SELECT count(*) AS n FROM customer) AS c"""
