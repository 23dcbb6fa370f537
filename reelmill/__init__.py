"""Spark-native analytics over per-frame sequence data."""

from reelmill.session import table

__all__ = ["table"]
