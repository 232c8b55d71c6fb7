"""Interval, text-feature and ranking analytics as PySpark DataFrame operators."""
