"""Batch retrieval and evaluation over large text tables, on Spark DataFrames."""
