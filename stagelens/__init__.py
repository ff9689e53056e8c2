"""Analytics over Spark's own telemetry, as Spark DataFrames."""

__version__ = "0.1.0"
