"""Exposure-aware access analytics as Spark DataFrame operators."""
