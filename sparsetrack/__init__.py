"""Analytics on sparse numeric signals along named integer axes, in Spark DataFrames."""

__version__ = "0.1.0"
