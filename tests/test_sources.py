from __future__ import annotations

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurespark.errors import DataAccessError, FeatureSparkError
from featurespark.functions.text import double_text, token_estimate, value_text
from featurespark.operators.transforms import apply_fitted, get_transformation
from featurespark.session import cut_lineage, shared_folder
from featurespark.sources.csv import inferred_kinds, read_csv, split_records
from featurespark.streaming.apply import transform_stream, write_stream

CSV = '''id,count,price,flag,text,empty,big,inf,mixed
1,5,1.5,True,plain,,99999999999999999999,inf,1
2,NA,2e3,false,"quoted, ""so""",,1,-inf,x
3,,n/a,TRUE,NULL,,2,3.5,2
4,-7,.5,,été,,3,,
'''


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "table.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_words(spark, csv_path):
    df = read_csv(spark, csv_path)
    assert dict(df.dtypes) == {
        "id": "bigint", "count": "bigint", "price": "double", "flag": "boolean", "text": "string",
        "empty": "double", "big": "double", "inf": "double", "mixed": "string",
    }
    rows = {row["id"]: row for row in df.collect()}
    assert [rows[n]["count"] for n in (1, 2, 3, 4)] == [5, None, None, -7]
    assert [rows[n]["price"] for n in (1, 2, 3, 4)] == [1.5, 2000.0, None, 0.5]
    assert [rows[n]["flag"] for n in (1, 2, 3, 4)] == [True, False, True, None]
    assert [rows[n]["text"] for n in (1, 2, 3, 4)] == ["plain", 'quoted, "so"', None, "été"]
    assert [rows[n]["inf"] for n in (1, 2, 3, 4)] == [math.inf, -math.inf, 3.5, None]
    expected = pd.read_csv(csv_path)
    assert expected["price"].isna().sum() == df.where("price IS NULL").count()


def test_csv_with_schema_reads_once(spark, csv_path):
    df = read_csv(spark, csv_path, "id int, count double, price double, flag string, text string")
    assert [row["count"] for row in df.orderBy("id").collect()] == [5.0, None, None, -7.0]
    assert df.schema["id"].dataType.simpleString() == "int"


def test_csv_columns_go_by_name_and_quotes_hold_line_breaks(spark, tmp_path):
    path = tmp_path / "two.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(map(tuple, read_csv(spark, str(path)).collect())) == [(1, "x\ny"), (2, "z")]
    swapped = read_csv(spark, str(path), "b string, a int")
    assert swapped.columns == ["b", "a"] and sorted(map(tuple, swapped.collect())) == [("x\ny", 1), ("z", 2)]
    with pytest.raises(DataAccessError):
        read_csv(spark, str(path), "c int")


def messy_csv(seed, rows=120, end="\n"):
    """Records with quotes, doubled quotes, separators and line breaks inside of values, blank lines, long values."""
    rng = random.Random(seed)
    pieces = ["x", "y z", '"', ",", "\n", "\n\n", "été", '""', "1", ""]
    records = []
    for i in range(rows):
        cells = ["".join(rng.choice(pieces) for _ in range(rng.randrange(5))) for _ in range(2)]
        cells[1] += "long\n" * 40 if i % 29 == 7 else ""
        records.append([str(i), *cells])
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in r) for r in [["id", "a", "b\nb"], *records])
    return (text + "\n\n").replace("\n", end)


@pytest.mark.parametrize(("size", "end"), [(37, "\n"), (400, "\n"), (90, "\r\n"), (1 << 20, "\n")])
def test_csv_in_byte_ranges_equals_one_task(spark, tmp_path, size, end):
    for seed in (1, 2):
        (tmp_path / f"{seed}.csv").write_bytes(messy_csv(seed, end=end).encode())
    expected = spark.read.options(header="true", escape='"', multiLine="true").csv(str(tmp_path))
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = read_csv(spark, str(tmp_path), missing_words=())
        assert found.columns == expected.columns and len(found.columns) == 3
        if size < 1000:
            assert found.rdd.getNumPartitions() > 10
        rows = sorted((int(r[0]), r[1] or "", r[2] or "") for r in found.collect())
        assert rows == sorted((int(r[0]), r[1] or "", r[2] or "") for r in expected.collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize(
    "text", ['a,b\n1,5" pipe\n2,6" pipe\n3,"x\ny"\n', 'a,b\n1,"odd\n', 'a,b\n1,x"y\n2,"z"\n', 'a,b\n1,"p" q\n2,r\n']
)
def test_csv_with_other_quotes_is_read_by_one_task(spark, tmp_path, text):
    path = tmp_path / "odd.csv"
    path.write_text(text)
    expected = spark.read.options(header="true", escape='"', multiLine="true").csv(str(path)).collect()
    assert split_records(spark, str(path)) is None
    assert [r["b"] for r in read_csv(spark, str(path)).collect()] == [r["b"] for r in expected]


def test_csv_types_of_many_columns_in_one_read(spark, tmp_path):
    cells = [("i", "7"), ("d", "1.5"), ("b", "true"), ("t", "x"), ("e", "")]
    path = tmp_path / "wide.csv"
    header = ",".join(f"{kind}{k}" for k in range(24) for kind, _ in cells)
    path.write_text(header + "\n" + (",".join(v for _ in range(24) for _, v in cells) + "\n") * 3)
    tracker, group = spark.sparkContext.statusTracker(), "one read"
    text = spark.read.option("header", "true").csv(str(path))
    spark.sparkContext.setJobGroup(group, "")
    kinds = inferred_kinds(text)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 2  # the read, and the rows that it sent
    want = {"i": "integer", "d": "double", "b": "boolean", "t": "text", "e": "double"}
    assert kinds == {name: want[name[0]] for name in header.split(",")}


NUMBERS = [
    0.0, 1.0, -1.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.5e-4, 1e-5, -2.5e-7, 1e100,
    1.7976931348623157e308, math.inf, -math.inf, 0.1, 9999999.0, -12345678.25, 1e22,
]


def test_double_text(spark):
    rng = random.Random(9)
    numbers = NUMBERS + [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 20) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "x double").coalesce(1)
    texts = [row[0] for row in df.select(double_text(F.col("x"))).collect()]
    assert [float(text) for text in texts] == numbers
    assert [t for t, n in zip(texts, numbers) if len(t) == len(repr(n)) and t != repr(n)] == []
    assert texts[: len(NUMBERS)] == [repr(n) for n in NUMBERS]
    assert spark.sql("SELECT CAST(NULL AS double) x").select(double_text(F.col("x"))).first()[0] is None


def test_value_text(spark):
    df = spark.createDataFrame(
        [(True, dt.date(2024, 1, 2), [1], {"b": 1, "a": 2}, bytearray(b"\x01"), None)],
        "b boolean, d date, l array<int>, m map<string,int>, x binary, n double",
    )
    texts = list(df.select(*[value_text(field) for field in df.schema.fields]).first())
    assert texts == ["True", "2024-01-02", "[1]", '[{"key":"a","value":2},{"key":"b","value":1}]', "01", None]


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("é" * 9,), (None,)], "t string").coalesce(1)
    assert [row[0] for row in df.select(token_estimate(F.col("t"))).collect()] == [1, 1, 2, None]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("id", "cast(id as double) x").write.parquet(source)
    table = spark.read.parquet(source)
    fitted = [get_transformation("standard_scale").fit(table, {"column": "x"})]
    stream = spark.readStream.schema(table.schema).parquet(source)
    write_stream(transform_stream(stream, fitted), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = apply_fitted(table, *fitted)
    assert found.count() == 100 and found.exceptAll(expected).count() == 0
    with pytest.raises(DataAccessError):
        transform_stream(table, fitted)


def test_checkpoints_go_to_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(10))
    assert df.count() == 10 and "RDD" in df._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(FeatureSparkError):
        shared_folder(Session())
