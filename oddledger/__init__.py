"""Spark-native detection of unusual financial transactions.

Every operator takes DataFrames and returns DataFrames; see README.md.
"""
