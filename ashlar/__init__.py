"""Spark-first analytics for building models and relational tables."""
