"""Spark-native analytics for cell-site telemetry.

Every operator is a function from DataFrames to a DataFrame; no operator runs
an action of its own, so plans compose and Catalyst sees the whole query.
"""

__version__ = "0.1.0"
