"""Operators for building language-model training corpora on Spark.

Every operator takes DataFrames and column names and returns a DataFrame; nothing
outside this subpackage imports it.
"""
