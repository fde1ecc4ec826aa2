"""Spark-first analytics over LLM post-training data."""

__version__ = "0.1.0"
