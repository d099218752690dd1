"""Parquet tables and version snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from featurespark.operators.transforms import Fitted, apply_fitted


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _version_folder(path: str, dataset: str, version: int) -> str:
    """A folder of its own: a number that is used again after a rollback gets another one, so that versions which
    are still read are never overwritten."""
    return f"{path}/{dataset}/version={version}-{uuid.uuid4().hex[:8]}"


def write_snapshot(df: DataFrame, path: str, dataset: str, version: int) -> tuple[DataFrame, str]:
    """Write a whole table version; returns it as read back, which also ends a chain of steps, and its folder."""
    target = _version_folder(path, dataset, version)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target), target


def write_recipe(spark: SparkSession, path: str, dataset: str, version: int, base: str, steps: Sequence[Fitted]) -> str:
    """Write a version as the fitted steps that make it from a whole snapshot: a few lines, however large the table."""
    target = _version_folder(path, dataset, version)
    lines = [json.dumps({"base": base}), *(step.to_json() for step in steps)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(target)
    return target


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """A version as it was written, by another session as well: a snapshot, or a recipe and the snapshot under it."""
    lines = [row["value"] for row in spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).collect()]
    if not lines:
        return spark.read.parquet(folder)
    base, *steps = lines[0].splitlines()
    return apply_fitted(spark.read.parquet(json.loads(base)["base"]), *map(Fitted.from_json, steps))
