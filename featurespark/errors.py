"""Errors raised before a Spark job starts, so that a bad request fails where it is made."""


class FeatureSparkError(Exception):
    """Base class of every error raised by this package."""


class DataAccessError(FeatureSparkError):
    """The request names an unknown column, version or operation, or its parameters do not fit."""


class PolicyViolationError(FeatureSparkError):
    """The request touches a blocked or sensitive column."""
