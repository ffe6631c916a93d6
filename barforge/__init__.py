"""Barforge: Spark-first analytics for daily bar panels and event tables."""
