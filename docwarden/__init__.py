"""Static risk analysis of document packages on Spark."""

__version__ = "0.2.0"
