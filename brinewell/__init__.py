"""Spark-first analytics over prediction-market streams and the tables around them."""

__version__ = "0.1.0"
