"""Ordinal grading tables on Spark."""
