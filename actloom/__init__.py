"""Spark-first analytics over versioned regulatory documents."""

__version__ = "0.1.0"
