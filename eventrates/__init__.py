"""Event-rate tables and clustered binary regression on Spark DataFrames."""

__version__ = "0.1.0"
