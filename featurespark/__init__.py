"""Profiling, guarding and feature engineering of tables on Spark."""

from featurespark.errors import DataAccessError, FeatureSparkError, PolicyViolationError
from featurespark.operators.transforms import Fitted, Transformation, list_transformations, register, transform
from featurespark.plans.plan import Proposal, read_plan, run_plan
from featurespark.plans.table import TableHandle
from featurespark.session import get_session
from featurespark.sources.csv import read_csv

__all__ = [
    "DataAccessError",
    "FeatureSparkError",
    "Fitted",
    "PolicyViolationError",
    "Proposal",
    "TableHandle",
    "Transformation",
    "get_session",
    "list_transformations",
    "read_csv",
    "read_plan",
    "register",
    "run_plan",
    "transform",
]
