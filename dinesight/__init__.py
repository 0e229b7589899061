"""Dining-safety analytics as Spark DataFrame operators."""
