from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from featurespark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Twelve people with a missing age, addresses, customer numbers and three categories."""
    rows = [
        (None if i == 7 else 20.0 + (i * 13) % 41, 40_000 + 1_250 * i + (i * 977) % 700, f"p{i}@example.org",
         f"C-{1000 + i}", ("north", "south", "west")[i % 3])
        for i in range(12)
    ]
    return spark.createDataFrame(
        rows, "age double, income bigint, email string, customer_id string, category string"
    )
